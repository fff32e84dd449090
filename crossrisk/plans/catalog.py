"""Imports every query module so that the registry is complete."""

from . import backtests, fundamental, landing, macro, screen, series, structure  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
