"""Named queries: each applies an operator to the star-schema tables, beside SQL that gives the same rows."""

from . import aggregates, domain, files, joins, models, scalars
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "aggregates", "domain", "files", "joins", "models", "scalars"]
