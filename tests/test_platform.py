"""Skew, plans, sources, and the SQL cross-check."""

import re

import pytest
from check_oracle import compare, duck
from frames import at, enabled, incidents, jobs, taskers
from pyspark.sql import functions as F

from outlast.catalog.oracles import oracle_statements
from outlast.catalog.queries import QUERIES
from outlast.operators import cohort as co
from outlast.operators import features as ft
from outlast.session import cut_lineage
from outlast.sources import tables

SMALL = "/root/testdata/sf0.001"


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_key_is_split_by_the_join_before_aggregation(spark):
    """One key with most of the history: its join partition is read in pieces, the aggregate stays right."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
                "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        ids = spark.range(0, 40_000, 1, 8).select(
            F.when(F.col("id") % 3 != 0, 1).otherwise(F.col("id") % 50).cast("bigint").alias("tasker_id"), "id")
        history = ids.select("tasker_id", (F.lit(str(at(0))).cast("timestamp_ntz")
                             + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("updated_at"),
                             F.col("id").alias("rev"), F.col("id").cast("double").alias("score_punctuality"))
        landmarks = history.groupBy("tasker_id").agg(F.expr("max(updated_at) - INTERVAL 60 MINUTES").alias("landmark_at"))
        snapshot = co.asof_snapshot(cut_lineage(history), cut_lineage(landmarks))
        plan = final_plan(snapshot)
        assert "skew=true" in plan.lower() or "skewed" in plan.lower()
        got = {r["tasker_id"]: r["score_punctuality"] for r in snapshot.collect()}
        pdf = history.toPandas().merge(landmarks.toPandas())
        want = pdf[pdf.updated_at <= pdf.landmark_at].groupby("tasker_id")["rev"].max()
        assert got == {k: float(v) for k, v in want.items()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_scans_are_pruned(spark):
    plan = QUERIES["cohort_summary"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    lineitem = [s for s in re.findall(r"ReadSchema: (struct<[^\n]*)", plan) if "l_orderkey" in s]
    assert lineitem and all("l_extendedprice" not in s for s in lineitem)
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan
    assert any("l_returnflag" in p for p in re.findall(r"PushedFilters: \[[^\]]*\]", plan))


def test_window_join_has_no_python_and_one_fact_scan(spark):
    cohort = cut_lineage(co.build_cohort(
        taskers(spark, [enabled(1)]), jobs(spark, [{"tasker_id": 1, "job_date": at(299)}]), incidents(spark, []),
        co.CohortRules(cutoff=str(at(360)), city=None, state=None)))
    facts = cut_lineage(jobs(spark, [{"tasker_id": 1, "job_date": at(1)}]))
    executed = ft.window_jobs(cohort, facts)._jdf.queryExecution().executedPlan()
    plan = executed.toString()
    assert len(re.findall(r"FileScan parquet \[[^]]*job_id", plan)) == 1 and "Python" not in plan
    assert "Python" not in ft.distance_stats(cohort, facts)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"DataFilters: \[[^]]*job_date[^]]*subquery", plan, re.I)


# ---- sources --------------------------------------------------------------------------------

def test_parquet_source_turns_nan_into_null(spark, tmp_path):
    for name in ("taskers", "jobs", "incidents"):
        tables.write_table(spark.createDataFrame([(1, float("nan")), (2, 1.5)], "tasker_id INT, x DOUBLE"),
                           str(tmp_path / f"{name}.parquet"))
    got = tables.load_source(spark, "bruto", {"bruto": str(tmp_path)})
    assert sorted(map(tuple, got.jobs.collect()), key=str) == [(1, None), (2, 1.5)]
    with pytest.raises(ValueError, match="unknown source"):
        tables.load_source(spark, "other")


def test_rewriting_a_partitioned_table_drops_stale_partitions(spark, tmp_path):
    path, ddl = str(tmp_path / "pdp"), "atributo STRING, valor DOUBLE"
    tables.write_table(spark.createDataFrame([("a", 1.0), ("b", 2.0)], ddl), path, ["atributo"])
    tables.write_table(spark.createDataFrame([("b", 3.0)], ddl), path, ["atributo"])
    assert [r["atributo"] for r in spark.read.parquet(path).collect()] == ["b"]


def test_run_log_appends(spark, tmp_path):
    metrics = spark.createDataFrame([("m", 0.5)], "modelo STRING, c DOUBLE")
    for name in ("one", "two"):
        log = tables.log_run(name, {"seed": 42}, metrics, str(tmp_path / "log"))
    rows = {r["nome"]: r for r in log.collect()}
    assert sorted(rows) == ["one", "two"] and '"modelo":"m"' in rows["one"]["metricas"]


# ---- cross-check ----------------------------------------------------------------------------

FAST = ["cohort_summary", "sensitivity_grid", "milestones", "asof_snapshot", "cohort", "feature_matrix",
        "kaplan_meier_ci", "harrell_c", "friedman", "cd_groups", "normalize_text_documents", "stratified_folds"]


@pytest.mark.parametrize("name", FAST)
def test_queries_agree_with_sql(spark, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    assert compare(got, duck(SMALL).execute(oracle_statements()[name]).df()) is None


def test_every_statement_names_a_query():
    assert set(oracle_statements()) <= set(QUERIES)


def test_golden_numbers(spark):
    r = QUERIES["cohort_summary"](spark, SMALL).first()
    assert (r["n_profissionais"], r["n_eventos"], r["tempo_mediano"], r["tempo_max"]) == (143, 32, 1826.0, 2223.0)
