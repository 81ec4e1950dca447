"""Transcript and compliance analytics on Spark."""

import sys

from pyspark import cloudpickle

# the small Python helpers inside tasks travel with the job: executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
