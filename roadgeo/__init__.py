"""Road-network and vehicle-track geometry on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Arrow functions and the PBF source run in Python workers. Shipping the package by value lets a
# job run on executors that have no copy of it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
