"""Spark-native analytics over collections of long scholarly documents."""

import sys

from pyspark import cloudpickle

# executors need no installed copy: functions and classes of this package travel with the tasks
cloudpickle.register_pickle_by_value(sys.modules[__name__])
