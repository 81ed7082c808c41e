"""storyloom: news-intelligence analytics as plain DataFrame functions on Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel with the job; workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
