"""A Spark-first engine for cross-document reconciliation."""

import sys

from pyspark import cloudpickle

#: Functions handed to executors travel with their plan, so workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
