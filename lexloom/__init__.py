"""lexloom: a rule engine over token streams, planned and run by Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run on executors travel with their code, so executors need no
# copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
