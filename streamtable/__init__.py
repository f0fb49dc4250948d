"""streamtable: one programming model for data at rest and data in motion, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so that executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
