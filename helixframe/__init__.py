"""Population-genomic analytics as DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python functions of this package travel with their tasks: executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
