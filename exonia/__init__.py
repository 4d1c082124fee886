"""exonia: gene-structure analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks are sent with the code they use, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
