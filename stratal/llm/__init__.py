"""Operators for large-scale training-data pipelines (nothing else in the library imports this package)."""

import sys

from pyspark import cloudpickle

# Worker functions travel with their code, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
