"""Lectern: a PySpark-native engine for questioning a corpus by reading whole documents."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
