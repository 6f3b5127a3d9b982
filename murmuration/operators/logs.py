"""Aggregating and tabular logs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Reductions by name; each is one that partial results can be merged by.
REDUCTIONS: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "avg": F.avg, "product": F.product, "any": F.bool_or, "all": F.bool_and, "bit_or": F.bit_or, "bit_and": F.bit_and, "bit_xor": F.bit_xor,
}
_KINDS = {int: "long", float: "double", "int": "long", "float": "double"}


@dataclass(frozen=True)
class Logged:
    """One logged column: source column, reduction, name in the log and type.

    The reduction is one by name, or a function that makes an aggregate of a column; it sees rows in no order.
    """

    source: str
    reduction: str | Callable[[Column], Column]
    name: str
    kind: str | None = None

    def column(self) -> Column:
        reduce = self.reduction if callable(self.reduction) else REDUCTIONS[self.reduction]
        out = reduce(F.col(self.source))
        return (out.cast(self.kind) if self.kind else out).alias(self.name)


def logged_fields(record: type, reduction: str, names: dict[str, str | None] | None = None) -> list[Logged]:
    """A column for each field of a dataclass, or for those in names, under the new name given there.

    A name that is no field is a ValueError.
    """
    if unknown := set(names or {}) - {f.name for f in fields(record)}:
        raise ValueError(f"{record.__name__} has no field {', '.join(sorted(unknown))}")
    out = []
    for f in fields(record):
        if names is None or f.name in names:
            out.append(Logged(f.name, reduction, (names or {}).get(f.name) or f.name, _KINDS.get(f.type)))
    if not out:
        raise ValueError(f"no field of {record.__name__} is named")
    return out


def reduced(rows: DataFrame, columns: list[Logged], tick: str = "tick") -> DataFrame:
    """One row for each tick: rows from all tiles reduced column by column. All columns take one aggregation."""
    return rows.groupBy(tick).agg(*(c.column() for c in columns))


def tabular(rows: DataFrame, headers: list[str], rank: str = "uid_rank", seq: str = "seq") -> DataFrame:
    """Rows in order of rank, and within a rank as logged."""
    return rows.orderBy(rank, seq).select(*headers)


def running(rows: DataFrame, value: str, order: str, by: tuple[str, ...] = (), name: str = "total", before: bool = False) -> DataFrame:
    """rows, one for each (by, order), with the sum of value so far; without the row's own if `before`.

    The rows of one `by` are added up in one task, as those of an agent or, with none, the ticks of a log.
    """
    window = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    return rows.withColumn(name, F.coalesce(F.sum(value).over(window), F.lit(0)))
