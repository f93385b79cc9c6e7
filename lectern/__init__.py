"""Learning-corpus analytics as Spark DataFrame transformations."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

__version__ = "0.1.0"

# Task functions travel by value, so executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])
