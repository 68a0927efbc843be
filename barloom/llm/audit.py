"""Filter interaction audit: what every order of a few filters removes, from one count of each failure mask.

Documents are counted by part and by the set of filters that they fail, their mask. In a given order a
mask is removed by its first failing filter, and the orders that begin with the same letters are
consecutive in lexicographic order: their Lehmer ranks form an interval. So each mask adds its count
at the start of an interval and takes it away behind the end, a prefix sum over the ranks gives what
every order removes at each step, and no order is ever run over the documents.

Defined results: null text is empty; a null part is the empty string; a null doc_id is neither smaller
nor larger than another, so it never makes or is a copy; rows that share doc_id and text aren't copies of
each other; a document without a label, or whose doc_id is null, is neither good nor toxic, and one with
several labels is each that any of them says; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, prepare

_SPACE = "[ \\t\\n\\x0B\\f\\r]+"
#: What is summed over documents.
COUNTS = ("n", "good", "toxic")


def text_failures(text: Column) -> dict[str, Column]:
    """A: under 200 words; B: under half of the words are distinct; C: over 2 % of the characters are A-Z; D: holds a mark of code."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, _SPACE), "")
    n = F.size(words).cast("long")
    return {
        "A": n < 200,
        "B": F.size(F.array_distinct(words)).cast("long") * 100 < n * 50,
        "C": F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.length(text).cast("long") * 2,
        "D": text.rlike(r"[#$%&*|]"),
    }


def copies(rows: DataFrame, tables: Tables) -> DataFrame:
    """rows (doc_id, digest, ...) with `copy`: a smaller doc_id has the same digest.

    The smallest doc_id of a digest comes from partial minima, and only digests of several rows are
    joined back, from a written table: so a hot digest is a side of the join that adaptive execution can split."""
    first = tables.write(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "firsts")
    return rows.join(first, "digest", "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))).drop("first")


def masks(docs: DataFrame, labels: DataFrame, tables: Tables) -> DataFrame:
    """part, mask, n, good, toxic: documents by source and by the filters that they fail (bit k: the k-th letter)."""
    text = F.coalesce("text", F.lit(""))
    flags = text_failures(F.col("text"))
    rows = docs.select(
        "doc_id",
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        *(c.alias(name) for name, c in flags.items()),
    )
    rows = tables.write(rows.select("doc_id", "part", "digest", _mask([F.col(c) for c in flags]).alias("mask")), "failures")
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic")
    )
    rows = copies(rows, tables).join(marks, "doc_id", "left")
    mask = F.col("mask") + F.col("copy").cast("int") * (1 << len(flags))
    return rows.groupBy("part", mask.alias("mask")).agg(
        F.count("*").alias("n"), *(F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in ("good", "toxic"))
    )


def _mask(flags: list[Column]) -> Column:
    return sum((f.cast("int") * (1 << k) for k, f in enumerate(flags)), F.lit(0))


def orders(letters: str) -> list[str]:
    """All orders, by their Lehmer rank."""
    if not letters:
        return [""]
    return [x + rest for i, x in enumerate(letters) for rest in orders(letters[:i] + letters[i + 1 :])]


def intervals(size: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, start, end): the ranks start to end - 1 of the orders of `size` filters that remove a document of this mask at this step.

    They begin with the same step - 1 filters, which it passes, and one that it fails."""
    out = []

    def walk(left: list[int], start: int, mask: int, step: int) -> None:
        for k, x in enumerate(left):
            lo = start + k * factorial(len(left) - 1)  # the Lehmer digit: smaller filters that are still left
            if mask >> x & 1:
                out.append((mask, step, lo, lo + factorial(len(left) - 1)))
            else:
                walk(left[:k] + left[k + 1 :], lo, mask, step + 1)

    for mask in range(1, 1 << size):
        walk(list(range(size)), 0, mask, 1)
    return out


def audit(counts: DataFrame, letters: str) -> DataFrame:
    """counts (part, mask, n, good, toxic) -> a row per part, order of the letters and step.

    part, filter_order, step; kept after the step; removed, good_lost and toxic_lost in it; redundant: fail
    its filter, but were removed earlier; unique_fails: fail its filter only; shapley: removed by its filter in all orders together.
    """
    spark, size = counts.sparkSession, len(letters)
    ends = [(m, s, at, sign) for m, s, lo, hi in intervals(size) for at, sign in ((lo, 1), (hi, -1)) if at < factorial(size)]
    ends = F.broadcast(spark.createDataFrame(ends, "mask int, step int, rank int, sign int"))  # of a size that depends on the number of filters alone
    steps = counts.join(ends, "mask").groupBy("part", "step", "rank").agg(*(F.sum(F.col(c) * F.col("sign")).alias(c) for c in COUNTS))
    fails = lambda k: F.sum(F.when(F.col("mask").bitwiseAND(1 << k) != 0, F.col("n")).otherwise(0))
    only = lambda k: F.sum(F.when(F.col("mask") == 1 << k, F.col("n")).otherwise(0))
    parts = counts.groupBy("part").agg(F.sum("n").alias("all"), F.array(*map(fails, range(size))).alias("fails"), F.array(*map(only, range(size))).alias("only"))
    grid = parts.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(size)))).withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(factorial(size) - 1))))
    by_rank = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    by_step = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    by_filter = Window.partitionBy("part", "letter")
    rows = grid.join(steps, ["part", "step", "rank"], "left").fillna(0, list(COUNTS))
    rows = rows.select("*", *(F.sum(c).over(by_rank).alias(f"{c}_removed") for c in COUNTS))
    rows = rows.withColumn("filter_order", F.element_at(F.array(*map(F.lit, orders(letters))), F.col("rank") + 1))
    rows = rows.withColumn("letter", F.instr(F.lit(letters), F.expr("substr(filter_order, step, 1)")))
    return rows.select(
        "part",
        "filter_order",
        "step",
        (F.col("all") - F.sum("n_removed").over(by_step)).alias("kept"),
        F.col("n_removed").alias("removed"),
        (F.element_at("fails", F.col("letter")) - F.col("n_removed")).alias("redundant"),
        F.element_at("only", F.col("letter")).alias("unique_fails"),
        F.col("good_removed").alias("good_lost"),
        F.col("toxic_removed").alias("toxic_lost"),
        F.sum("n_removed").over(by_filter).alias("shapley"),
    )


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the text filters A to D and of E, copies of a smaller doc_id's text, in each source."""
    prepare(docs.sparkSession)
    with Tables(docs.sparkSession) as tables:
        counts = tables.write(masks(docs, labels, tables), "masks")
        tables.keep(counts)
    return audit(counts, "ABCDE")
