"""Corvane: a PySpark-native analytics engine for retrieval, ranking, evaluation and text corpora."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
