"""chartloom: table and stream operators for clinical messages and reference documents."""

from pyspark import cloudpickle as _cloudpickle

import sys as _sys

# Task functions travel to the executors by value, so a cluster needs no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
