"""Session settings for operators that hand whole texts to Python workers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

from outlast import session

ROWS_PER_BATCH = 1024  # texts are wide: two batches are held on either side of the pipe


def configure(spark: SparkSession) -> SparkSession:
    """The library's settings, smaller batches, and workers that import the package from where the driver has it.

    On a cluster without that folder the package has to be shipped with the job (``--py-files``).
    """
    session.configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([p for p in paths if p] + [root])
    return spark
