"""tidemark: signal, point-process, statistics, colour and grid analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions run in Python workers travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
