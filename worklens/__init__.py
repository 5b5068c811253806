"""Oversight analytics for public-works spending, as ordinary Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions handed to executors travel by value, so a job also runs where the package is
# only on the driver's path (no --py-files needed).
cloudpickle.register_pickle_by_value(sys.modules[__name__])
