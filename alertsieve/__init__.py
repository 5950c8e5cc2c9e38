"""Ticket and alert triage analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# Python functions go to the executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
