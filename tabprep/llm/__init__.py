"""Operators that prepare text corpora for language-model training.

Nothing outside this folder imports it, and it can be removed as a whole.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Tasks get these functions with the job, so executors need no copy of the package.
register_pickle_by_value(sys.modules[__name__])
