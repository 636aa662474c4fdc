"""All queries, by importing the modules that register them."""

from . import gates, joins, streams, texts, transcripts, windows  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
