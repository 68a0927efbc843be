"""Display text as Column expressions; a dash for what is not finite."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "–"


def _fixed(v: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", v.cast("double"))


def _or_dash(v: Column, text: Column) -> Column:
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), DASH).otherwise(text)


def _sign(v: Column) -> Column:
    return F.when(v > 0, "+").otherwise("")


def pct(v: Column, digits: int = 1) -> Column:
    return _or_dash(v, F.concat(_fixed(v * 100, digits), F.lit("%")))


def signed_pct(v: Column, digits: int = 1) -> Column:
    return _or_dash(v, F.concat(_sign(v), _fixed(v * 100, digits), F.lit("%")))


def num(v: Column, digits: int = 2) -> Column:
    return _or_dash(v, _fixed(v, digits))


def signed(v: Column, digits: int = 2) -> Column:
    return _or_dash(v, F.concat(_sign(v), _fixed(v, digits)))


def integer(v: Column) -> Column:
    return _or_dash(v, F.format_number(F.floor(v + 0.5), 0))


def compact(v: Column) -> Column:
    size = F.abs(v)
    text = F.when(size >= 1e9, F.concat(_fixed(v / 1e9, 1), F.lit("B"))).when(size >= 1e6, F.concat(_fixed(v / 1e6, 1), F.lit("M")))
    return _or_dash(v, text.when(size >= 1e3, F.concat(_fixed(v / 1e3, 1), F.lit("k"))).otherwise(_fixed(v, 0)))


def duration(ms: Column) -> Column:
    s = ms / 1000
    m = F.floor(s / 60)
    text = F.when(ms < 1000, F.concat(F.floor(ms + 0.5).cast("string"), F.lit("ms"))).when(s < 60, F.concat(_fixed(s, 1), F.lit("s")))
    text = text.otherwise(F.concat(m.cast("string"), F.lit("m "), F.floor(s - m * 60 + 0.5).cast("string"), F.lit("s")))
    return F.when(ms < 0, DASH).otherwise(_or_dash(ms, text))


def short_date(d: Column) -> Column:
    return F.date_format(d, "dd/MM/yy")


def month_label(d: Column) -> Column:
    return F.date_format(d, "MMM yyyy")


def title_case(s: Column) -> Column:
    spaced = F.regexp_replace(s, "([a-z])([A-Z])", "$1 $2")
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 1_000_000))
