"""gridframe: analyses of gridded space-time data as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from gridframe.model import Grid

# Functions run inside tasks travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Grid"]
