"""Every operator as a query over the test tables."""

from . import cubes, kernels, recordings, signals, stats
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "cubes", "kernels", "recordings", "signals", "stats"]
