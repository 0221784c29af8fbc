"""Wardenlake: governance analytics over file, event and planning tables, on Spark."""

import sys

from pyspark import cloudpickle

# Batch functions travel to the executors by value, so a cluster needs no copy of this
# package on its Python path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
