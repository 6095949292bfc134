"""Event-stream and point-process analytics on Spark."""

import sys

from pyspark import cloudpickle

# Workers get the package's functions with the task, so they need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
