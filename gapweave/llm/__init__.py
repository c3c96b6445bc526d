"""Operators for building training corpora, one module each; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Task functions carry their code along, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
