"""Meeting-decision analytics as lazy PySpark DataFrame operators."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions go to the executors by value: the package needn't be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
