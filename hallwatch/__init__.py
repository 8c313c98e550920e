"""Camera-observation analytics on Spark DataFrames and Structured Streaming."""

import sys

from pyspark import cloudpickle

# Kernels travel with the job, so Python workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
