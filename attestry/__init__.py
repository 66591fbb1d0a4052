"""Attestry: document integrity, evidence and scoring as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors by value, so workers need not have this package
# installed or on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
