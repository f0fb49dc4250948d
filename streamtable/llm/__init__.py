"""Operators for preparing language-model training data. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so that executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
