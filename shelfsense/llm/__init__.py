"""Operators for large training-data pipelines (text, vectors, conversations).

Nothing else in the library imports this subpackage.  Operators that run
Python inside tasks are shipped to the executors by value, so a cluster needs
PySpark, NumPy and PyArrow but no installed copy of this package.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
