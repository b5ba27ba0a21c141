"""Column functions: text, hashes, vectors, rounding, distributions, and functions by name."""

import sys

from pyspark import cloudpickle

# functions travel to the executors as code, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
