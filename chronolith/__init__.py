"""Chronolith: bitemporal knowledge analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Workers get our functions by value, so they need no copy of this package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
