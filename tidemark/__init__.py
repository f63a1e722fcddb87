"""Text-corpus, retrieval and telemetry analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions sent to the executors travel by value, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
