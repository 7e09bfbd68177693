"""batchloom: prepare, run and track large batched workloads with PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code along, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
