"""All registered queries of the library's own operators."""

from . import links, scalars, state, trees  # noqa: F401 - importing registers them
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
