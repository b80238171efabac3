"""tessera: conversational-memory analytics expressed as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package that run on executors travel with their code, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
