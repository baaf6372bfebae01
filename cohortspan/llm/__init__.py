"""Operations of a training-data pipeline, each a job of DataFrames.

Functions that run inside tasks are shipped with the job itself, so executors
need no copy of this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
