"""Chat, corpus and media analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions run in tasks travel by value: executors need the libraries they use, not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
