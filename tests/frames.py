"""Small inline tables in the input schemas."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from outlast.sources.schema import INCIDENTS_DDL, JOBS_DDL, TASKERS_DDL

DAY0 = datetime(2024, 1, 1)


def at(days: float) -> datetime:
    return DAY0 + timedelta(days=days)


def _frame(spark, ddl: str, rows: list[dict]):
    names = [part.split()[0] for part in ddl.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ddl)


def taskers(spark, rows: list[dict]):
    base = {"city": "São Paulo", "state_uf": "sp", "created_at": at(-10)}
    rows = [{**base, "rev": i, **r} for i, r in enumerate(rows)]
    return _frame(spark, TASKERS_DDL, rows)


def jobs(spark, rows: list[dict]):
    return _frame(spark, JOBS_DDL, [{"job_id": i, **r} for i, r in enumerate(rows)])


def incidents(spark, rows: list[dict]):
    return _frame(spark, INCIDENTS_DDL, [{"incident_id": i, "type": "cancel", **r} for i, r in enumerate(rows)])


def enabled(key: int, day: float = 0, **more) -> dict:
    return {"tasker_id": key, "updated_at": at(day), "state": "enabled", **more}


def survival(spark, rows):
    return spark.createDataFrame([(float(t), bool(e)) for t, e in rows], "tempo DOUBLE, evento BOOLEAN")


def by_key(df, key: str = "tasker_id") -> dict:
    return {r[key]: r for r in df.collect()}


def scattered(df, n: int = 5):
    """The same rows in another partitioning."""
    return df.repartition(n, F.rand(1))
