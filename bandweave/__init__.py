"""Spark DataFrame operators for multi-label pixel tables and their review loop."""

import sys

from pyspark import cloudpickle

# Functions that run in workers travel with the query, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
