"""PySpark-native engine for hierarchical, time-aligned scoring data."""

import sys

from pyspark import cloudpickle

# Functions go to the workers by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
