"""The registered queries of the library and the SQL that states the same."""

from __future__ import annotations

from .plans import oracles_io, queries_io  # noqa: F401: each adds its queries, or their SQL, to the first module's
from .plans.oracles import ORACLES
from .plans.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
