"""Colloquy: a Spark-native engine for conversation analytics."""

import sys

from pyspark import cloudpickle

# functions sent to executors carry the library's code, so executors needn't have it on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
