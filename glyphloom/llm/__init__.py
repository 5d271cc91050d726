"""Operators of a training-data pipeline; nothing else in the library imports them.

Python workers get these functions by value, so executors need no copy of the package.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
