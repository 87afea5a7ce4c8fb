"""DataFrame operators for tables, document collections, evidence and traces."""

import sys

from pyspark import cloudpickle

# workers get functions by value, so the package need not be installed on them
cloudpickle.register_pickle_by_value(sys.modules[__name__])
