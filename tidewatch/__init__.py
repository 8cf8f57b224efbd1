"""Monitoring of recurring file deliveries, written as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# The few Python kernels travel to the executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
