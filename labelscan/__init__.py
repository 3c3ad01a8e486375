"""Packaged-goods label compliance analytics on Spark."""

import sys

from pyspark import cloudpickle

# the small helpers inside UDFs travel with the task, so executors need no install
cloudpickle.register_pickle_by_value(sys.modules[__name__])
