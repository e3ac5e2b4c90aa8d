"""opslake: fleet operations data on Spark (logs, snapshots, inventory, history, model replies)."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions that run inside tasks travel with the job, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
