"""Queries of the engine over the driver's tables, with the same in SQL."""

from tidemark.queries import adapters, candidates, display, entries, history, identities, listings, reports, rules, sources, state, text, topics, trends  # noqa: F401
from tidemark.queries.base import ORACLES, QUERIES  # noqa: F401
