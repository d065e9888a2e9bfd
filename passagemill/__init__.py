"""Passage retrieval over tables of documents and tables of questions, on Spark."""

import sys

from pyspark import cloudpickle

# Ship the package's own functions inside the pickled task, so executors need
# no copy of it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
