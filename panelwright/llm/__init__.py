"""Operators for preparing training text at scale. Nothing else in the library imports this subpackage.

Functions that run in tasks are shipped by value, so executors need numpy and pyarrow but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
