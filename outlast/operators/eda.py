"""Descriptive tables of the inputs and of the cohort."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlast.operators.cohort import KEY, distinct_days, summarize


def time_describe(cohort: DataFrame) -> DataFrame:
    """Event rate (3 decimals) and the usual description of the survival time, exact quartiles.

    Everything comes from the distinct-day counts, so the quartiles hold a few thousand values.
    """
    n = F.col("n")
    days = distinct_days(cohort).agg(
        F.sum("n").alias("count"), F.sum(F.col("tempo") * n).alias("_sum"), F.sum("d").alias("_d"),
        F.min("tempo").alias("min"), F.max("tempo").alias("max"),
        F.percentile("tempo", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), n).alias("_q"),
        F.collect_list(F.struct("tempo", "n")).alias("_days"))
    mean = F.try_divide(F.col("_sum"), F.col("count"))
    squares = F.aggregate("_days", F.lit(0.0), lambda acc, day: acc + day["n"] * F.pow(
        day["tempo"] - F.col("mean"), 2))
    return days.withColumn("mean", mean).select(
        F.round(F.try_divide(F.col("_d").cast("double"), F.col("count")), 3).alias("taxa_evento"),
        "count", "mean", F.when(F.col("count") > 1, F.sqrt(F.try_divide(squares, F.col("count") - 1))).alias("std"),
        "min", F.col("_q")[0].alias("p25"), F.col("_q")[1].alias("p50"), F.col("_q")[2].alias("p75"), "max")


def activation_funnel(taskers: DataFrame) -> DataFrame:
    """Distinct professionals, those ever enabled, and the share. One row per key first: one
    shuffle, no row expansion as two distinct counts would need."""
    keys = taskers.groupBy(KEY).agg(F.bool_or(F.col("state") == "enabled").alias("on"))
    return keys.agg(
        F.count("*").alias("n_profissionais"), F.count_if("on").alias("n_ativados"),
        F.try_divide(F.count_if("on").cast("double"), F.count("*").cast("double")).alias("taxa_ativacao"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.count("*").alias("linhas")).select(F.lit(name).alias("tabela"), "linhas")
              for name, df in tables.items()]
    return reduce(DataFrame.unionAll, counts)


def round_numbers(df: DataFrame, decimals: int) -> DataFrame:
    floats = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float")}
    return df.select([F.round(c, decimals).alias(c) if c in floats else F.col(c) for c in df.columns])


def descriptive_table(cohort: DataFrame, n_predictors: int) -> DataFrame:
    """The cohort summary as label / text pairs ready to print."""
    whole = lambda c: F.format_string("%.0f", F.rint(c))
    s = summarize(distinct_days(cohort))
    count = lambda c: F.col(c).cast("string")
    pairs = [  # fixed values: the labels of the published table
        ("Profissionais", count("n_profissionais")),
        ("Eventos (churn)", count("n_eventos")),
        ("Censurados", count("n_censurados")),
        ("Taxa de evento", F.format_string("%.1f%%", F.col("taxa_evento") * 100)),
        ("Tempo mediano (dias)", whole("tempo_mediano")),
        ("Tempo máximo (dias)", whole("tempo_max")),
        ("Atributos preditores", F.lit(str(n_predictors))),
    ]
    rows = F.array(*[F.struct(F.lit(i).alias("ordem"), F.lit(label).alias("indicador"), value.alias("valor"))
                     for i, (label, value) in enumerate(pairs)])
    return s.select(F.explode(rows).alias("r")).select("r.*")
