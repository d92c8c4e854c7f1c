"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors by value, so that no executor needs the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
