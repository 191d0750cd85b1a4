"""Training-data operators.  Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions for tasks travel with their code: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
