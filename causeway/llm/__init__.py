"""Corpus operators for training data: one module an operator. Nothing else in causeway imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the workers whole, so executors need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
