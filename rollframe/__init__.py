"""Rollout and post-training tables on Spark.

Every operator is a plain function from DataFrame to DataFrame.  Nothing in
this package collects table rows to the driver.
"""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors by value, so these need no installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
