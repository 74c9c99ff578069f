"""Operators for preparing training corpora: duplicates, quality, extraction, scans, mixing, sharding."""

import sys

from pyspark import cloudpickle

# What runs inside tasks travels with them, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
