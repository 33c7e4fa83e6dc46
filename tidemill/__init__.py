"""Round-robin time-series analytics and corpus preparation on Apache Spark."""

import sys

from pyspark import cloudpickle

#: Functions of this package travel to executors by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
