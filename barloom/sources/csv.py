"""Price CSV: headers matched by name, values cleaned, last row of a symbol and day wins."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bars import on_common_calendar

# Accepted headers, the preferred first.
HEADERS = {
    "date": ("date", "timestamp", "time", "datetime"),
    "symbol": ("symbol", "ticker", "asset", "instrument", "name"),
    "open": ("open", "o"),
    "high": ("high", "h"),
    "low": ("low", "l"),
    "close": ("close", "adj close", "adj_close", "adjclose", "last", "price"),
    "volume": ("volume", "vol", "qty"),
}
LEAST_BARS, FEW_BARS = 300, 400


@dataclass
class Report:
    rows_read: int = 0
    rows_kept: int = 0
    symbols: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


class BadCsv(ValueError):
    pass


def split_line(line: str) -> list[str]:
    """Cells between commas, semicolons or tabs outside quotes; a doubled quote is a quote."""
    cells, cell, quoted, k = [], [], False, 0
    while k < len(line):
        c = line[k]
        if c == '"':
            if quoted and line[k + 1 : k + 2] == '"':
                cell.append('"')
                k += 1
            else:
                quoted = not quoted
        elif c in ",;\t" and not quoted:
            cells.append("".join(cell).strip())
            cell = []
        else:
            cell.append(c)
        k += 1
    return [*cells, "".join(cell).strip()]


def find_header(header: list[str], keys: tuple[str, ...]) -> int | None:
    """Exact matches of all keys first, then headers that hold a key; the first key wins."""
    names = [h.strip().lower() for h in header]
    for key in keys:
        if key in names:
            return names.index(key)
    for key in keys:
        for i, name in enumerate(names):
            if key in name:
                return i
    return None


def cells_of(line: Column) -> Column:
    """split_line as a Column: separators outside quotes, quotes removed."""
    parts = F.split(line, '[,;\\t](?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    quote = F.lit('"')

    def plain(cell: Column) -> Column:
        c = F.trim(cell)
        whole = F.replace(F.substring(c, 2, F.length(c) - 2), F.lit('""'), quote)
        return F.trim(F.when(c.rlike('(?s)^".*"$'), whole).otherwise(F.replace(c, quote, F.lit(""))))

    return F.transform(parts, plain)


def number(cell: Column) -> Column:
    """Money, percent and thousands signs dropped; blank is 0, unreadable null."""
    bare = F.regexp_replace(cell, r"[$,%\s]", "")
    return F.when(bare == "", F.lit(0.0)).otherwise(bare.try_cast("double"))


def day(cell: Column) -> Column:
    """An ISO prefix, else some usual notations; else null."""
    formats = ("M/d/yyyy", "yyyy/M/d", "d MMM yyyy", "MMM d, yyyy", "MMM d yyyy", "yyyy-M-d")
    iso = F.when(cell.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(cell, 1, 10).try_cast("date"))
    other = [F.to_date(F.try_to_timestamp(cell, F.lit(f))) for f in formats]
    return F.coalesce(iso, *other)


def clean(cells: DataFrame, header: list[str]) -> DataFrame:
    """line_no and cells -> symbol, date, open, high, low, close, volume, line_no of the usable rows."""
    at = {k: find_header(header, v) for k, v in HEADERS.items()}
    if at["date"] is None or at["close"] is None:
        raise BadCsv("a date and a close column are needed")
    cell = lambda k: F.get(F.col("cells"), F.lit(at[k])) if at[k] is not None else F.lit(None).cast("string")
    raw = cells.select("line_no", day(cell("date")).alias("date"), F.coalesce(F.nullif(cell("symbol"), F.lit("")), F.lit("IMPORT")).alias("s"), *(number(cell(k)).alias(k) for k in ("open", "high", "low", "close", "volume")))
    good = raw.where(F.col("date").isNotNull() & F.col("close").isNotNull() & (F.col("close") > 0) & ~F.isnan("close") & (F.col("close") < float("inf")))
    opened = good.withColumn("open", F.coalesce("open", "close"))
    return opened.select(
        F.substring(F.upper("s"), 1, 12).alias("symbol"), "date", "open",
        F.coalesce("high", F.greatest("close", "open")).alias("high"), F.coalesce("low", F.least("close", "open")).alias("low"),
        "close", F.coalesce("volume", F.lit(0.0)).alias("volume"), "line_no",
    )


def last_wins(rows: DataFrame) -> DataFrame:
    """One row for each symbol and date, that of the last line."""
    fields = ["open", "high", "low", "close", "volume"]
    last = rows.groupBy("symbol", "date").agg(F.max_by(F.struct(*fields), "line_no").alias("r"))
    return last.select("symbol", "date", "r.*")


def read_csv(spark: SparkSession, path: str) -> tuple[DataFrame, Report]:
    """Bars on the common calendar, and a report. Raises BadCsv for unusable input."""
    lines = spark.read.option("wholetext", "false").text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line")).where(F.trim("line") != "")
    return from_lines(lines)


def from_lines(lines: DataFrame) -> tuple[DataFrame, Report]:
    """line_no and line, the header first."""
    first = lines.orderBy("line_no").limit(3).collect()
    if len(first) < 3:
        raise BadCsv("fewer than three lines")
    header = split_line(first[0]["line"].removeprefix("﻿"))
    body = lines.where(F.col("line_no") > first[0]["line_no"]).select("line_no", cells_of(F.col("line")).alias("cells"))
    rows = clean(body, header)
    kept = rows.groupBy("symbol").agg(F.count("*").alias("n")).withColumn("read", body.agg(F.count("*")).scalar()).collect()  # a row a symbol
    if not kept:
        raise BadCsv("no usable row")
    report = Report(rows_read=kept[0]["read"], rows_kept=sum(r["n"] for r in kept))
    report.symbols = sorted(r["symbol"] for r in kept)
    bars = on_common_calendar(last_wins(rows))
    common = bars.agg(F.countDistinct("t")).first()[0]
    if common < LEAST_BARS:
        raise BadCsv(f"{common} common bars; {LEAST_BARS} are needed")
    if common < FEW_BARS:
        report.warnings.append(f"only {common} common bars")
    if report.rows_kept < report.rows_read:
        report.warnings.append(f"{report.rows_read - report.rows_kept} rows dropped")
    return bars.select("symbol", "t", "date", "open", "high", "low", "close", "volume"), report




def write_bars(bars: DataFrame, path: str) -> None:
    """Parquet, one folder a symbol."""
    bars.write.mode("overwrite").partitionBy("symbol").parquet(path)
