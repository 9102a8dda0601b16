"""slatewise: batch and streaming Spark operators for recommender data."""

import sys

from pyspark import cloudpickle

# The few Python functions that run inside tasks travel with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
