"""Operators for preparing training text. Nothing outside this folder imports it."""

import sys

from pyspark import cloudpickle

# functions sent to executors carry their code, so that workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
