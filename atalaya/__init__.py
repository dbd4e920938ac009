"""Listing monitor on Spark: captures in, items, changes and reports out."""

import sys

from pyspark import cloudpickle

# Executors get the few Python helpers with the job, not from an installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
