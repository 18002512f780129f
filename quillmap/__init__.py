"""A rule catalogue on Spark; see README.md."""

import sys

from pyspark import cloudpickle

# Task functions travel by value: executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
