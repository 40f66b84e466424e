"""All queries of the vector engine."""

from . import formats, hashing, quantizers, search, transforms  # noqa: F401
from .fixtures import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
