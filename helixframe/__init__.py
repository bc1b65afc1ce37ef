"""helixframe: sequence-overlap graphs and corpus preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so that a cluster's workers
# need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
