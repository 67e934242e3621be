"""Versioned tables and artefacts on Spark: change capture, segments, snapshots, history, diff, scan, restore."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

#: Functions sent to Python workers travel by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
