"""Sparse time-series analytics and corpus preparation on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers by value, so a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
