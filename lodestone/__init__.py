"""Document-retrieval analytics on PySpark: read, chunk, store, search, evaluate."""

from pyspark import cloudpickle

import lodestone as _self

# Executors may not have this package on their path: ship functions by value.
cloudpickle.register_pickle_by_value(_self)
