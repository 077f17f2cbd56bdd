"""codeweft: analytics over large, versioned source-code corpora, as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
