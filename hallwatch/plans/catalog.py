"""All registered queries."""

from __future__ import annotations

from hallwatch.plans import report_queries, scene_queries, stream_queries, track_queries  # noqa: F401  (registration)
from hallwatch.plans.registry import QUERIES, Query


def all_queries() -> dict[str, Query]:
    return dict(QUERIES)


def all_checks() -> dict[str, str]:
    return {name: q.check for name, q in QUERIES.items() if q.check}
