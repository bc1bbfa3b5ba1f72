"""Operators of a large-scale training-data pipeline.

Nothing outside this folder imports it.  The functions that run inside tasks
are shipped by value, so that executors need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
