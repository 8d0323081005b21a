"""Operators of a training-data pipeline over documents, vectors and pages."""

import sys

from pyspark import cloudpickle

# Functions that tasks run travel with the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
