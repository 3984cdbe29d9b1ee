"""Operators for large training corpora.

Nothing outside this subpackage imports it.  Functions handed to Spark's
Python workers are pickled by value, so a cluster needs no copy of the
repository on its executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
