"""DataFrame operators for biological-sequence tables on Apache Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value, so executors do not need
# this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
