"""Relation extraction by distant supervision, and training-data operators, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

#: Python functions of the package travel to the executors by value, so these need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
