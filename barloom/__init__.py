"""Barloom: a Spark-native analytics engine for ordered market bars.

Functions that run inside Python workers are pickled by value, so executors
need neither this package on their path nor a shared source folder.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
