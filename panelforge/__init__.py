"""panelforge: Spark-native preparation and analysis of survey simulation data."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python workers get this package's functions with the job, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
