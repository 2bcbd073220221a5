"""Spark-native processing of episode-structured recordings."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors with their code, which then need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
