"""Operators for training-data pipelines, with the queries registered for them.

Nothing else in the library imports this subpackage. Code that runs in Python workers is
shipped by value, so executors need numpy, pandas, pyarrow and tokenizers but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
