"""Operators for preparing training text; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers with the job, wherever the driver found the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
