"""Panel analytics on Spark: entity-by-period features, signals, simulations and statistics."""

import sys

from pyspark import cloudpickle

# Task functions travel inside the plan, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
