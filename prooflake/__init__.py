"""prooflake: evidence-set analytics and training-data operators as Spark plans."""

import sys

from pyspark import cloudpickle

# Functions of this package that run in Python workers travel by value, so executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
