"""Operators for training data. Functions travel to the Python workers by value, so
executors need no copy of this package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
