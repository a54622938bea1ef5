"""Operators for training-data pipelines.

Tasks run functions of this package on the executors. They are shipped by value,
so executors need numpy, pyarrow and the tokenizer libraries, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
