"""Every registered query of the library: name -> Spark function, and name -> SQL that DuckDB answers alike."""

from __future__ import annotations

from .base import ORACLES, QUERIES
from . import building, called, dialogue, events, sampling, scoring, text  # noqa: F401, E402  they register themselves

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]

FLAGSHIP = "structural_reasons"
