"""Options-exposure and flow analytics expressed as Spark DataFrame jobs."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run in Python workers travel inside the job, so executors need
# no installed copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
