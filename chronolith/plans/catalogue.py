"""Every registered query of the library and its SQL."""

from . import audits, backtests, blocks, daily, featured, more, panels, wider  # noqa: F401  registers
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
