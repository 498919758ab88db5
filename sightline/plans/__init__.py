"""Plans shared by operators. Functions that run in Python workers travel by value, so executors need no copy."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
