"""gridweave: table sync, record linkage and site audit as Spark jobs.

Every operator takes and returns DataFrames (or Columns); nothing is collected
on the driver except counts that end a loop and bounded lists of split points.
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Task-side helpers travel with the job, so executors need no installed copy.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
