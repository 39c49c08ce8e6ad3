import sys

from pyspark import cloudpickle

# The stand-in provider travels to executors by value, like the library's own stages.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
