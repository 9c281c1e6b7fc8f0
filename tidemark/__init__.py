"""Event-stream analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# The few Python functions that run inside tasks travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
