"""The library's own queries by name, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from . import registry
from .operators import aggregates, assets, caps, cases, chunking, cleaning, dedupe, drafts, evaluation, evidence, excerpts, joins, knowledge, lookups, masking, materials, predicates, projections, ranking, records, reuse, scoring, search, similar, taxonomy, validation  # noqa: F401  they register their queries
from .plans import compiling, requirements  # noqa: F401
from .sources import json_strings  # noqa: F401
from .streaming import index_sink, replay  # noqa: F401


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
