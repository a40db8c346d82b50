"""Telemetry anomaly analytics written as plain Spark DataFrame jobs."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run on executors travel with the job, so workers need no installed copy.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
