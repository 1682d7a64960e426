"""Survival and churn-cohort analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Ship the small helpers used inside tasks along with the task: executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
