"""Longitudinal, paired-observation analytics as Spark plans."""

import sys

from pyspark import cloudpickle

# The library's functions travel to the executors by value, which need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
