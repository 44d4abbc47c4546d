"""PySpark-native engine that mines source trees into a catalogue of validated capabilities."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so a cluster needs no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
