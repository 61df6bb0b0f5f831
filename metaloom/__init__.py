"""Spark-native dataset profiling and catalogue metadata."""

import sys

from pyspark import cloudpickle

# Tasks get the functions themselves: executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
