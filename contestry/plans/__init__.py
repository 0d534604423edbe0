"""Registered queries; importing the package fills registry.QUERIES and registry.ORACLE_SQL."""

from contestry.plans import registry  # noqa: F401  isort:skip
from contestry.plans import careers, cases, changes, columns, live, lookups, pages, resolution, reviews, search, serving  # noqa: F401
