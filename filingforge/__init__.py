"""Analytics over corporate filings, as DataFrame operations."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so executors need nothing installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
