"""Spark-native retrieval, evaluation and corpus preparation."""

import sys

from pyspark import cloudpickle

# Worker functions travel with their code, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
