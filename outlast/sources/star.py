"""The three input tables as views over a TPC-H-like star schema.

One row per order becomes a state change of its customer, one line item a job, one returned line
item an incident. All views are plain projections over equi-joins, so pruning and pushdown reach
the parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlast.functions.scalar import ntz
from outlast.session import configure
from outlast.sources.tables import Tables


# Declared, so that opening a table costs no footer-reading job.
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, "
                "l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
}


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _coordinate(base: float, number) -> F.Column:
    return F.lit(base) + (F.pmod(number, F.lit(1000)) - 500) / F.lit(4000.0)


def taskers_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, rev, at = F.col("o_custkey"), F.col("o_orderkey"), F.col("o_orderdate")
    status = F.col("o_orderstatus")
    disabled = (F.col("o_orderpriority") == "5-LOW") & (rev % 5 == 0)
    day = lambda n: F.make_dt_interval(days=n)
    score = lambda modulus, scale: 1 + (rev % modulus) / F.lit(float(scale))
    rows = (scan(spark, sf_dir, "orders")
            .join(scan(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(scan(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(scan(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")))
    return rows.select(
        key.alias("tasker_id"), at.alias("updated_at"), rev.alias("rev"),
        F.when(status == "O", "onboarding").when(status == "P", "enabled")
        .when(disabled, "disabled").otherwise("suspended").alias("state"),
        (ntz("1995-01-01") - day((key % 60).cast("int"))).alias("created_at"),
        F.when(rev % 3 != 0, at + F.make_dt_interval(hours=F.lit(8))).alias("current_sign_in_at"),
        F.col("r_name").alias("city"), F.concat(F.lit("R"), F.col("r_regionkey")).alias("state_uf"),
        F.when(key % 10 != 0, F.when(key % 7 == 0, "masculino").otherwise("feminino")).alias("gender"),
        F.when(key % 12 != 0, ntz("1960-01-01") + day((key * 37 % 14600).cast("int"))).alias("birthdate"),
        F.col("n_name").alias("category"), F.col("c_mktsegment").alias("plan"),
        F.col("o_orderpriority").alias("indication"),
        F.when(key % 20 != 0, _coordinate(-23.55, key * 7919)).alias("latitude"),
        F.when(key % 20 != 0, _coordinate(-46.63, key * 104729)).alias("longitude"),
        (1 + key % 5).cast("int").alias("n_servicos_oferecidos"),
        F.when(key % 10 < 7, "approved").when(key % 10 < 9, "pending").alias("photo_identity_state"),
        F.when(rev % 2 == 0, (rev % 100) / F.lit(100.0)).alias("photo_identity_score"),
        F.when(rev % 2 == 0, at).alias("photo_identity_checked_at"),
        F.when(rev % 4 != 0, 1 + F.col("o_totalprice") * 4 / F.lit(500000.0)).alias("score_punctuality"),
        F.when(rev % 6 != 0, score(31, 7.5)).alias("score_friendliness"),
        F.when(rev % 7 != 0, (rev % 67) / F.lit(66.0)).alias("retention_rate"),
        F.when(rev % 5 != 0, (rev % 101) / F.lit(100.0)).otherwise(0.0).alias("preferential_rate"),
        F.when(rev % 2 == 0, score(41, 10)).alias("score_limpeza"),
        (rev % 20).cast("int").alias("n_aval_limpeza"),
        F.when(rev % 4 == 1, score(29, 7)).alias("score_limpeza_express"),
        (rev % 5).cast("int").alias("n_aval_limpeza_express"),
        F.when(rev % 5 == 2, score(23, 6)).alias("score_limpeza_pesada"),
        F.when(rev % 11 != 0, (rev % 3).cast("int")).alias("n_aval_limpeza_pesada"),
        F.when(rev % 3 == 0, score(37, 10)).alias("score_montagem"),
        (rev % 7).cast("int").alias("n_aval_montagem"),
        F.when(rev % 7 == 3, score(19, 5)).alias("score_passadoria"),
        (rev % 2).cast("int").alias("n_aval_passadoria"),
    )


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = scan(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return scan(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def _line_id() -> F.Column:
    return F.col("l_orderkey") * 10 + F.col("l_linenumber")


def jobs_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, line, at = F.col("l_partkey"), F.col("l_linenumber"), F.col("l_shipdate")
    price = F.col("l_extendedprice")
    return _lines(spark, sf_dir).select(
        F.col("o_custkey").alias("tasker_id"), _line_id().alias("job_id"), at.alias("job_date"),
        (F.col("l_quantity") * 10).alias("work_time"),
        (part % 6).cast("double").alias("feedback_score"),
        (price * (1 - F.col("l_discount"))).alias("final_payout"),
        _coordinate(-23.55, part * 31).alias("latitude"), _coordinate(-46.63, part * 17).alias("longitude"),
        (F.col("l_returnflag") == "A").alias("preferential"),
        (F.col("l_linestatus") == "O").alias("performed_by_preferential"),
        (line % 5).cast("string").alias("service"), (F.col("l_suppkey") % 2 == 0).alias("subscription"),
        F.when(F.col("l_tax") >= 0.06, price * F.col("l_tax")).otherwise(0.0).alias("bonus_payout"),
        F.when(part % 7 != 0, at - F.make_dt_interval(days=(line % 5).cast("int"))).alias("confirmed_at"),
    )


def incidents_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, quantity = F.col("l_linenumber"), F.col("l_quantity")
    return _lines(spark, sf_dir).where(F.col("l_returnflag") == "R").select(
        F.col("o_custkey").alias("tasker_id"), _line_id().alias("incident_id"),
        F.when(line % 3 == 0, "no_show").when(line % 3 == 1, "delayed").otherwise("cancel").alias("type"),
        F.col("l_shipdate").alias("incident_at"),
        F.when(line % 3 == 1, quantity * 60).otherwise(0.0).alias("time_delta"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("penalty_amount"),
        ((quantity >= 50) & (line == 1) & (F.col("l_discount") >= 0.09)).alias("disable_tasker"),
    )


def metrics_by_fold_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model x fold metric table: order statuses play the models, key residues the folds."""
    price = F.col("o_totalprice")
    return scan(spark, sf_dir, "orders").groupBy(
        F.col("o_orderstatus").alias("modelo"), (F.col("o_orderkey") % 10).cast("int").alias("fold")
    ).agg(
        (F.avg(price) / 500000).alias("c_uno"), (F.max(price) / 500000).alias("c_harrell"),
        (F.min(price) / 500000).alias("auc_media"), (F.stddev_samp(price) / 500000).alias("ibs"))


def star_tables(spark: SparkSession, sf_dir: str) -> Tables:
    configure(spark)
    return Tables(taskers_view(spark, sf_dir), jobs_view(spark, sf_dir), incidents_view(spark, sf_dir))
