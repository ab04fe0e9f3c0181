"""Sensor, questionnaire and message analytics written as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Arrow functions travel to the executors by value: workers need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
