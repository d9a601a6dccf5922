"""smilegrid: option-surface research operators on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Worker kernels travel with their code, so executors need only numpy and pandas.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
