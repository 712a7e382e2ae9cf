"""Movement and contact-event analytics over many recordings, as Spark DataFrame operators."""
import sys

from pyspark import cloudpickle

# The few Python kernels travel to the executors by value, so a cluster needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
