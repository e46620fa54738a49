"""Operators for large training-text corpora.

Nothing else in the library imports this subpackage.  The functions that run
inside Spark tasks are pickled by value, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
