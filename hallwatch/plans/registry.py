"""Collects every query with its survey id and, where SQL can express it, its check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hallwatch.plans.views import Views


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[[Views], DataFrame]
    check: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Views(spark, folder))


QUERIES: dict[str, Query] = {}


def query(*covers: str, check: str | None = None):
    def register(build: Callable[[Views], DataFrame]):
        QUERIES[build.__name__] = Query(build.__name__, covers, build, nudged(check) if check else None)
        return build
    return register


# Values that end exactly halfway are rounded differently by the two engines; this nudge, far above
# the floating-point noise and far below the last digit shown, puts them on one side in both.
NUDGE = 1e-12


def r6(c: Column | str, digits: int = 6) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(NUDGE), digits)


def nudged(check: str) -> str:
    """``round(x, n)`` of a check as ``round(x + nudge, n)``."""
    out, i = [], 0
    while (start := check.find("round(", i)) >= 0:
        depth, comma, j = 0, -1, start + 5
        while True:
            depth += {"(": 1, ")": -1}.get(check[j], 0)
            if check[j] == "," and depth == 1:
                comma = j
            if depth == 0:
                break
            j += 1
        inner = nudged(check[start + 6:comma])
        out += [check[i:start], f"round(({inner}) + {NUDGE}::DOUBLE{check[comma:j]})"]
        i = j + 1
    return "".join(out) + check[i:]


def whole(*names: str) -> list[Column]:
    """Integer columns as bigint, so that both engines report the same type."""
    return [F.col(n).cast("long").alias(n) for n in names]
