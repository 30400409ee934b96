"""Operators of a training-data pipeline over ``documents`` and ``embeddings``.

Nothing else in the library imports this package. Functions that run inside
tasks are pickled by value, so executors need no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
