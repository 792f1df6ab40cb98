"""Mail threat analytics on Spark: sources, clean-up, features, models and verdict tables."""

import sys

from pyspark import cloudpickle

# Python workers receive the helpers with the task instead of importing the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
