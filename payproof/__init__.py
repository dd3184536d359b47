"""Payment audit controls and corpus preparation as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.3.0"

# Functions that run on executors travel with the job, so that this package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
