"""Operators for building training corpora; nothing outside this subpackage imports it.

The functions that run inside tasks are shipped with the job, so that
executors need the third-party libraries only, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
