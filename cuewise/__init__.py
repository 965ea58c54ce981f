"""Timed-text analytics as plain Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Step functions of pandas stages travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
