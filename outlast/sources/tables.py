"""Reading and writing: the three input tables, result tables, CSV exchange, the run log."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlast.functions.scalar import nan_to_null

DEFAULT_SOURCES = {"sintetico": "dados/sintetico", "bruto": "dados/bruto"}


@dataclass(frozen=True)
class Tables:
    taskers: DataFrame
    jobs: DataFrame
    incidents: DataFrame


def without_nan(df: DataFrame) -> DataFrame:
    """NaN stands for "missing" in files written by pandas; in Spark that is null."""
    floats = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float")}
    return df.select([nan_to_null(F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return without_nan(spark.read.parquet(path))


def load_tables(spark: SparkSession, base_dir: str) -> Tables:
    """The three inputs under ``base_dir``; another source is simply another directory."""
    return Tables(*[read_table(spark, f"{base_dir}/{name}.parquet")
                    for name in ("taskers", "jobs", "incidents")])


def load_source(spark: SparkSession, source: str, sources: dict[str, str] = DEFAULT_SOURCES) -> Tables:
    if source not in sources:
        raise ValueError(f"unknown source {source!r}, expected one of {sorted(sources)}")
    return load_tables(spark, sources[source])


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Replace the table at ``path``. Partitioned tables drop their stale partitions as well."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").csv(path, header=True)
    return path


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a declared schema: no inference pass over the file."""
    return spark.read.schema(schema).csv(path, header=True)


def run_record(name: str, config: dict, metrics: DataFrame) -> DataFrame:
    """One row describing a run: name, time stamp, configuration and its (short) metric table."""
    rows = F.sort_array(F.collect_list(F.struct(*metrics.columns)))
    return metrics.agg(F.to_json(rows).alias("metricas")).select(
        F.lit(name).alias("nome"),
        F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss").alias("carimbo"),
        F.lit(json.dumps(config, default=str, ensure_ascii=False, sort_keys=True)).alias("config"),
        "metricas")


def log_run(name: str, config: dict, metrics: DataFrame, path: str) -> DataFrame:
    """Append the record to the JSON run log and return the log."""
    run_record(name, config, metrics).write.mode("append").json(path)
    return metrics.sparkSession.read.schema(
        "nome STRING, carimbo STRING, config STRING, metricas STRING").json(path)
