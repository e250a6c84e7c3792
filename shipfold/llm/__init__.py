"""Operators of a training-data pipeline; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Workers get the functions by value: a cluster's Python need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
