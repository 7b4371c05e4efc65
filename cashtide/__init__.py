"""Cash-flow analytics on Spark: ledger, daily series, features, KPIs and model trees."""

import sys

from pyspark import cloudpickle

# The few functions that run inside Python tasks travel with the job, so executors need no
# copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
