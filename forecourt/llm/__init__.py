"""Operators for training-data tables: deduplication, filters, formatting, classifiers, tokens.

Nothing else in the library imports this subpackage. Its task functions travel with the job, so
executors need no installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
