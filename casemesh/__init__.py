"""casemesh: complaint triage on Spark DataFrames, batch and streaming."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the tasks: executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
