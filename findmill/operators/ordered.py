"""Running values over ordered groups of any size.

A plain window sorts a whole group in one task, which fails when one key holds a large
part of the table. Here the group is cut into chunks along its order. Each chunk is first
reduced to one summary row (partial aggregation runs before the shuffle), the summaries of
earlier chunks are carried into each chunk, and the window then runs inside chunks only.
The result is the same as that of the plain window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CHUNK = "_chunk"


@dataclass(frozen=True)
class Running:
    """One running value.

    kind: ``count`` (1, 2, ...), ``sum`` (inclusive), ``max_before`` (of earlier rows),
    ``last`` (latest non-null value, inclusive), ``lag`` (value of the row before).
    """

    kind: str
    value: Column | None = None


def chunk_of(column: str, width: int) -> Column:
    """Chunk of an integer order column, in exact integer arithmetic."""
    return F.col(column) - F.pmod(F.col(column), F.lit(width))


def with_running(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column, specs: dict[str, Running]
) -> DataFrame:
    """Add running values per ``keys`` in ``order``.

    ``chunk`` must not decrease along ``order``, and ``order`` must be unique within keys.
    """
    df = df.withColumn(_CHUNK, chunk)
    by = [*keys, _CHUNK]

    def latest(spec: Running) -> Column:
        row = F.struct(*order, spec.value.alias("_v"))
        return F.max(row if spec.kind == "lag" else F.when(spec.value.isNotNull(), row))

    summary = {
        "count": lambda s: F.count(F.lit(1)),
        "sum": lambda s: F.sum(s.value),
        "max_before": lambda s: F.max(s.value),
        "last": latest,
        "lag": latest,
    }
    before = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    combine = {
        "count": F.sum,
        "sum": F.sum,
        "max_before": F.max,
        "last": lambda c: F.last(c, ignorenulls=True),
        "lag": lambda c: F.last(c, ignorenulls=True),
    }
    totals = df.groupBy(*by).agg(*[summary[s.kind](s).alias(f"_t_{n}") for n, s in specs.items()])
    carry = totals.select(*by, *[combine[s.kind](F.col(f"_t_{n}")).over(before).alias(f"_c_{n}") for n, s in specs.items()])

    inside = Window.partitionBy(*by).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)

    def value(n: str, s: Running) -> Column:
        c = F.col(f"_c_{n}")
        if s.kind == "count":
            return F.coalesce(c, F.lit(0)) + F.row_number().over(inside)
        if s.kind == "sum":
            return F.coalesce(c, F.lit(0)) + F.coalesce(F.sum(s.value).over(upto), F.lit(0))
        if s.kind == "max_before":
            return F.greatest(c, F.max(s.value).over(earlier))
        if s.kind == "last":
            return F.coalesce(F.last(s.value, ignorenulls=True).over(upto), c["_v"])
        return F.when(F.row_number().over(inside) == 1, c["_v"]).otherwise(F.lag(s.value).over(inside))

    joined = df.join(carry, by)
    return joined.select(*[c for c in df.columns if c != _CHUNK], *[value(n, s).alias(n) for n, s in specs.items()])
