"""Operators of a training-data pipeline. Nothing else in the package imports this subpackage."""

import sys

from pyspark import cloudpickle

# Executors get these functions with the job, so they need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
