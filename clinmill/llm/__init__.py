"""Training-data operators over documents and pages; nothing else in the package imports this one."""

import sys

from pyspark import cloudpickle

# functions travel to the executors with their code, so those need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
