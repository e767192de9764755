"""auditlake: auditing of source repositories, and of text corpora, as Spark DataFrames."""

from pyspark import cloudpickle as _cloudpickle

import auditlake as _self

__version__ = "0.1.0"

# Functions run on executors travel by value: a cluster needs no copy of this package on its nodes.
_cloudpickle.register_pickle_by_value(_self)
