"""Latent-variable models over sparse count data, expressed as Spark jobs."""

import sys

from pyspark import cloudpickle

# Kernels travel to Python workers by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
