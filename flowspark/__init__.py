"""flowspark: keyed, time-aware dataflows as Spark plans."""

import sys

from pyspark import cloudpickle

from .runtime import FlowError, RecoveryConfig, cluster_main, run_main, run_until_idle
from .stream import Flow, KeyedStream, Stream, operator

__all__ = ["Flow", "FlowError", "KeyedStream", "RecoveryConfig", "Stream", "cluster_main", "operator", "run_main", "run_until_idle"]

# Functions that run on executors travel inside the task, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
