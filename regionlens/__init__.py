"""Analytics over counts reported by region and date, as Spark DataFrame transforms."""

import sys

from pyspark import cloudpickle

# Executors may not have the package installed; ship the few Arrow-batch
# functions of this package with the task instead of importing them there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
