"""Spark operators for annotation tables of image data sets."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry this package's code with them: nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
