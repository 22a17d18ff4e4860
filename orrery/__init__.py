"""Analysis of ordered, high-dimensional observation series on Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
