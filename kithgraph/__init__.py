"""Stakeholder-graph analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so a cluster does not need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
