"""Registered queries: each area module adds its queries and their SQL twins."""

from vitrine.queries import attribution, catalog, chat, experiments, search, streams, triggers  # noqa: F401
from vitrine.queries.registry import ORACLES, QUERIES  # noqa: F401
