"""The package ships itself: functions used in tasks are pickled by value, so workers need no copy of the repository."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
