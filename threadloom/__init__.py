"""Support-conversation analytics and corpus preparation on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel inside the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
