"""Operators of a training-data pipeline: dedup, tokens, scoring, search, joins, mixing, sharding.

Nothing else in the library imports this package.
"""

import sys

from pyspark import cloudpickle

# Functions go to Python workers by value: a worker need not find this package on its own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
