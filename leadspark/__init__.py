"""Lead-intelligence jobs as plain Spark DataFrame transformations."""

import sys

from pyspark import cloudpickle

# Python functions travel to executors by value, so the package itself does not
# have to be installed on every node.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
