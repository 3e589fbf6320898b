"""faultloom: Spark-native root-cause analysis and causal discovery over metric time series."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to Python workers by value: a cluster needs no copy of it on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
