"""Operators for preparing language-model training text (see README, "Training-data operators").

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that a job runs
# from any working directory without the package being installed on the workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
