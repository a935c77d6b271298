"""Operators for preparing large text corpora; nothing outside this subpackage imports it."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions of this subpackage travel to the tasks by value, so that executors need no copy of it.
register_pickle_by_value(sys.modules[__name__])
