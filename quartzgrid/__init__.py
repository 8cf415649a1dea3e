"""Spark-native analytics over tabular documents: cells, regions, formulas, retrieval, diff and recalculation."""

import sys

from pyspark import cloudpickle

# Python workers get the package's functions by value: executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
