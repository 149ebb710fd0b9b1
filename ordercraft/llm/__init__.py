"""Operators for preparing language-model training data.

Each module holds one operator with its own DataFrame interface; ``queries``
registers the contract queries. Nothing outside this package imports it.
Functions of this package that run in Python workers travel by value, so
executors need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
