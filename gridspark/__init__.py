"""gridspark: grid-recognition analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their tasks, so that workers need not
# have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
