"""Operators of a training-data pipeline over a ``documents`` table.

Nothing outside this package and ``corpus_pipeline.py`` imports it. Functions
that run in Python workers are pickled by value, so executors need numpy,
pyarrow and (for the token operators) ``tokenizers``, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
