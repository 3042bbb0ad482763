"""All queries of the library and their SQL."""

from . import further, scenes  # noqa: F401  register their queries
from .queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
