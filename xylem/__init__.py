"""xylem: a PySpark-native engine for radial-signal images, job streams and corpora.

Functions of this package are pickled by value, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
