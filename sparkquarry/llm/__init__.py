"""Training-data operators: deduplication, filtering, sharding, tokenising.

Nothing else in the library imports this subpackage.  Every operator takes a
DataFrame plus column names and returns a DataFrame; ``queries.py`` holds the
thin ``opN_*`` queries that apply them to whole tables.
"""

import sys

from pyspark import cloudpickle

# functions travel to the executors as code, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
