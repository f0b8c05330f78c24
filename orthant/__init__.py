"""Vector analytics on Spark: vector columns, distances, aggregates, exact and approximate search."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package travel to the executors by value, so they need no installed copy of it.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
