"""The registered queries and their SQL counterparts."""

import sys

from pyspark import cloudpickle

from workload.registry import ORACLES, QUERIES  # noqa: I001
from workload import bank, texts  # noqa: F401

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["ORACLES", "QUERIES"]
