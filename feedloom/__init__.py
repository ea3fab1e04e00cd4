"""feedloom: posting-feed analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to Python workers by value, so that executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
