"""Operators as table functions of SQL: signal(TABLE(bars), family, params, side)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SelectedColumn

from ..schema import FAMILIES
from .arrays import Series
from .signals import RULES, signal

_COLUMNS = ("symbol", "t", "open", "high", "low", "close")


@dataclass
class Bound(AnalyzeResult):
    """What the arguments say, once for all partitions."""

    family: str = ""
    params: dict = field(default_factory=dict)
    side: str = "both"
    with_bench: bool = False


def _bound(bars: AnalyzeArgument, family: AnalyzeArgument, params: AnalyzeArgument | None, side: AnalyzeArgument | None) -> Bound:
    """Checks the arguments while the query is analysed. The table is dealt by symbol and ordered by t, whatever the caller says; only the columns needed are read."""
    if not bars.isTable:
        raise ValueError("the first argument is a table: signal(TABLE(bars), ...)")
    missing = [c for c in _COLUMNS if c not in bars.dataType.fieldNames()]
    if missing:
        raise ValueError(f"the table has no column {', '.join(missing)}")
    for name, x in (("family", family), ("params", params), ("side", side)):
        if x is not None and not x.isConstantExpression:
            raise ValueError(f"{name} must be a constant")
    if family.value not in RULES:
        raise ValueError(f"no family {family.value!r}; there are {', '.join(FAMILIES)}")
    bounds = FAMILIES[family.value][1]
    given = {k: float(v) for k, v in (params.value if params is not None else {}).items()}
    unknown = sorted(set(given) - set(bounds))
    if unknown:
        raise ValueError(f"{family.value} has no parameter {', '.join(unknown)}; it has {', '.join(bounds)}")
    lacking = sorted(set(bounds) - set(given))
    if lacking:
        raise ValueError(f"{family.value} needs {', '.join(lacking)}")
    bench = "bench" in bars.dataType.fieldNames()
    out = StructType().add("symbol", bars.dataType["symbol"].dataType).add("t", IntegerType()).add("signal", DoubleType())
    return Bound(
        schema=out, partitionBy=[PartitioningColumn("symbol")], orderBy=[OrderingColumn("t")], select=[SelectedColumn(c) for c in (*_COLUMNS, *["bench"] * bench)],
        family=family.value, params=given, side=side.value if side is not None else "both", with_bench=bench,
    )


@udtf
class SignalFunction:
    """symbol, t, signal: the exposure that a strategy wants on every bar of each symbol. Without a column bench, the market's returns count as 0."""

    def __init__(self, bound: Bound):
        self.bound, self.rows = bound, []

    @staticmethod
    def analyze(bars: AnalyzeArgument, family: AnalyzeArgument, params: AnalyzeArgument | None = None, side: AnalyzeArgument | None = None) -> Bound:
        return _bound(bars, family, params, side)

    def eval(self, bars, family, params=None, side="both") -> None:
        self.rows.append(tuple(bars[k] for k in range(len(_COLUMNS) + self.bound.with_bench)))

    def terminate(self) -> Iterator[tuple]:
        if not self.rows:
            return
        symbol, t, *prices = zip(*self.rows)
        values = [np.array([np.nan if v is None else v for v in p], np.float64) for p in prices]
        if not self.bound.with_bench:
            values.append(np.zeros(len(t)))
        wanted = signal(Series(*values), self.bound.family, self.bound.params, self.bound.side)
        yield from zip(symbol, map(int, t), wanted.tolist())


def register(spark: SparkSession) -> None:
    """Makes signal() known to the session's SQL."""
    spark.udtf.register("signal", SignalFunction)
