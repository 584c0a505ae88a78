"""Panel analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions for Python workers travel with the task, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
