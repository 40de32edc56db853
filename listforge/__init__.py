"""Classified-listing pipeline and analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# The few Python functions that run in tasks travel with the plan, so executors do not need this
# package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
