"""The test tables seen as an issue tracker, the registered queries on them, and their SQL counterparts."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
