"""Set-at-a-time analysis of web pages and request captures on Spark."""

import sys

from pyspark import cloudpickle

# Worker functions travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
