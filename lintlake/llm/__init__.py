"""Operators of a training-data pipeline.  Nothing outside this folder imports it."""

import sys

from pyspark import cloudpickle

# Functions of this folder travel to executors by value; they need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
