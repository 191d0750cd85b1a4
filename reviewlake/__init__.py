"""reviewlake: code-review analytics as Spark DataFrame and Structured Streaming jobs."""

import sys

from pyspark import cloudpickle

# Functions for tasks travel with their code: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
