"""All registered queries (Spark) and their DuckDB oracles.

Each query takes (spark, sf_dir) and runs over whole tables.  Iterative
queries use fixed passes (eps < 0) so the generated SQL can replay them.
Every float output is rounded to 4 decimals on both sides (a few tiny
values are scaled first); every column has the same name on both sides.
"""

from __future__ import annotations

from .catalog import fcm_queries, io_queries, other_queries  # noqa: F401  (registration)
from .catalog.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
