"""Training-data operators on text corpora.

Functions of this package that run inside Spark tasks travel by value, so the
executors need no copy of the repository.  Nothing else in the library imports
this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
