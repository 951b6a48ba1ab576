"""Operators for training-data pipelines: dedup, filters, scoring, formatting and mixing.

Nothing else in the library imports this subpackage. Functions that run inside
Python workers travel with the job, so workers need not have the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
