"""Table analysis operators for Spark: profile, clean, relate, test, trend, model, retrieve."""

import sys

from pyspark import cloudpickle

from sextant.session import get_spark

# Ship the few Python helpers inside the tasks, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_spark"]
