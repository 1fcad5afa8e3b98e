"""Message archives to searchable thread corpora, as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so a session works the
# same whether or not the package is installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
