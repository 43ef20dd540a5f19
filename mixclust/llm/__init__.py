"""Operators for preparing language-model training data, on Spark DataFrames.

Nothing else in the library imports this subpackage. Its functions that run inside tasks are
pickled by value, so they travel with the job and executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
