"""quillon: a PySpark-native engine for inverted-index building, sizing and querying."""

import sys

from pyspark import cloudpickle

# Executors may not have this source tree on their path, so functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
