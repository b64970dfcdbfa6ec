"""Operators of a training-data pipeline: one module per operator, each with its query.

Functions that run inside tasks travel with the job, so executors need the libraries
but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
