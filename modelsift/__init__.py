"""Tabular model selection as Spark jobs: profile, clean, encode, select, split, tune, rank."""

import sys

from pyspark import cloudpickle

# functions sent to executors travel with their code, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
