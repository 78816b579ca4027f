"""Operators of a training-data pipeline over ``documents``, ``labels``,
``benchmark`` and ``conversations``.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.  Every
operator lives in one module; ``queries`` holds the thin ``opN_*`` queries.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: nothing need be
# installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
