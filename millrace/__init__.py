"""millrace: manufacturing and process analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Step functions travel to the executors by value, so the package needs to be
# installed on the driver only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
