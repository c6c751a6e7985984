"""Operators for preparing training data at scale; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# functions of this subpackage travel with the tasks, so executors need not have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
