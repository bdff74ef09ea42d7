"""groundwire: Spark jobs for assistant traffic, knowledge retrieval and their operations data."""

import sys

from pyspark import cloudpickle

from groundwire.config import EngineConfig

# Task functions travel with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["EngineConfig"]
