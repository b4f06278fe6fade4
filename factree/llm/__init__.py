"""Operators for preparing training data at scale; nothing outside this folder imports it."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel with their code, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
