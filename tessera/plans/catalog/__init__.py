"""One query for each operator, with its twin in DuckDB SQL where SQL can express it."""

from __future__ import annotations

from . import candidates, detection, evaluation, masks, rows, videos
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "candidates", "detection", "evaluation", "masks", "rows", "videos"]
