"""Session settings the operators rely on, and the one way used here to cut a long lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# A join on tasker_id is followed by a groupBy on tasker_id, so without the "force" flag AQE would
# refuse to split a hot key (the split breaks the co-partitioning the aggregate wants). With it AQE
# splits the hot partition and puts the exchange between partial and final aggregate instead.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings above; everything else stays as the cluster set it."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: what the cluster names, a scratch one only in local runs."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="run-")
        context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    Plans over the result start at a parquet scan: columns are pruned, sizes are known to the join
    planner, and a lost executor costs a re-read instead of a recomputation.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


AT_ONCE = 8  # fits whose jobs are submitted together; each holds a few broadcasts


def at_once(spark: SparkSession, calls: list[Callable[[], object]]) -> list:
    """The results of independent calls, whose Spark jobs are submitted side by side from threads, in the calls' order.

    A fit is a chain of small jobs, so one alone leaves most of a cluster idle. The first failure is raised.
    """
    if len(calls) < 2:
        return [call() for call in calls]
    inherit = inheritable_thread_target(spark)
    with ThreadPoolExecutor(min(AT_ONCE, len(calls))) as pool:
        return [done.result() for done in [pool.submit(inherit(call)) for call in calls]]


def write_parts(path: str, parts: dict[str, DataFrame]) -> None:
    """Write tables that belong together so that readers see all of them or those of the last complete write.

    The tables go to a fresh folder; then a row that names it is added to the manifest, which is the commit: an
    appended file appears whole. A failed write leaves the earlier tables in force.
    """
    version, spark = uuid.uuid4().hex, next(iter(parts.values())).sparkSession
    for name, table in parts.items():
        table.write.parquet(f"{path}/{version}/{name}")
    spark.createDataFrame([(version,)], "version STRING").selectExpr("version", "unix_micros(current_timestamp()) AS at").coalesce(
        1).write.mode("append").parquet(f"{path}/manifest")


def read_parts(spark: SparkSession, path: str):
    """A function from a part's name to its table, all of the last complete ``write_parts``."""
    version = spark.read.parquet(f"{path}/manifest").orderBy("at", "version").tail(1)[0]["version"]
    return lambda name: spark.read.parquet(f"{path}/{version}/{name}")
