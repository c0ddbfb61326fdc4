"""folioforge: record resolution, retrieval analytics and corpus preparation on PySpark DataFrames."""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions sent to executors carry their code along, so executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
