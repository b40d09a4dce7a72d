"""Operators of a training-data pipeline, their queries and their SQL.

Functions that run in tasks travel with the job (they are pickled by value), so the executors need
numpy, pandas and pyarrow (xxhash, regex and tokenizers for the operators that say so) but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
