"""Mixing sources to target weights by Pfair scheduling.

DataFrame functions only. Each source's rows are cut into blocks. Block i of a source
with share w of the places is released at floor(i / w) and due at ceil((i + 1) / w), for
i from 0; taking at every place the released block that is due first keeps every source
within one block of w times the place.

Integer weights repeat after their sum: a frame of that many places is scheduled once, from the
weights alone, and every block's place follows by arithmetic. When a source
runs out, the frames end and a new phase begins with the sources that are left, in the
same proportions; no row is dropped or repeated. Phases are at most as many as sources, worked
out on their block counts alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush
from math import gcd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a source at least, however few its rows.
LEAST_BUCKETS = 64
#: Places of a plan, over all phases, that are broadcast at most; a longer plan is joined by a shuffle.
BROADCAST_PLACES = 1_000_000


def frame(weights: list[int]) -> list[list[int]]:
    """For each source, the places its blocks take in one frame of sum(weights) places.

    The earliest due released block goes first, ties to the source that comes first. Sources wait
    in a heap, so a place costs the logarithm of their number.
    """
    n = sum(weights)
    out: list[list[int]] = [[] for _ in weights]
    released: list[tuple[int, int]] = []  # (due, source)
    coming: list[tuple[int, int]] = [(0, s) for s in range(len(weights))]  # (release, source), a heap
    for place in range(n):
        while coming and coming[0][0] <= place:
            s = heappop(coming)[1]
            heappush(released, (-(-(len(out[s]) + 1) * n // weights[s]), s))
        s = heappop(released)[1]
        out[s].append(place)
        if len(out[s]) < weights[s]:
            heappush(coming, (len(out[s]) * n // weights[s], s))
    return out


def phases(blocks: dict, weights: dict) -> list[tuple[int, dict, dict, int]]:
    """(first place, {source: first block}, {source: weight}, frames) until every source is used up.

    A phase runs whole frames while all its sources can fill them, or one frame in
    which some run short and leave their places empty.
    """
    left = {s: n for s, n in blocks.items() if n}
    done = dict.fromkeys(left, 0)
    at, out = 0, []
    while left:
        now = {s: weights[s] for s in left}
        whole = max(1, min(left[s] // now[s] for s in left))
        out.append((at, {s: done[s] for s in left}, now, whole))
        for s in list(left):
            used = min(left[s], whole * now[s])
            done[s] += used
            left[s] -= used
            if not left[s]:
                del left[s]
        at += whole * sum(now.values())
    return out


def _columns(docs: DataFrame, kept: list[str]) -> DataFrame:
    """source, and the rows as one column `own`, so that none of their names can be taken for one of ours."""
    return docs.select(F.col("source").alias("source"), F.struct(*(F.col(f"`{c}`") for c in kept)).alias("own"))


def number_rows(rows: DataFrame, counts: dict, bucket_rows: int) -> DataFrame:
    """Adds n: the row's number within its source, from 0, without one task for a source.

    Rows are dealt to hash buckets of each source, LEAST_BUCKETS and one more for every
    bucket_rows rows; a bucket's rows follow those of all earlier buckets, whose counts are
    a small table. The hash is of the doc_id and of the whole row, so rows that share a doc_id, or have none, are dealt out
    too; only rows that are equal in all columns stay together.
    """
    spark = rows.sparkSession
    cut = spark.createDataFrame([(s, LEAST_BUCKETS + n // bucket_rows) for s, n in counts.items()], "c string, buckets long")
    order = [F.xxhash64(F.lit(43), "own.doc_id"), F.col("own.doc_id"), F.col("whole")]
    whole = F.to_json("own") if "map<" in rows.schema["own"].dataType.simpleString() else F.col("own")  # maps can't be hashed
    dealt = rows.withColumn("whole", F.xxhash64(F.lit(47), whole)).join(F.broadcast(cut), F.col("source").eqNullSafe(F.col("c")))  # a row for each source
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64(F.lit(41), "own.doc_id", "whole"), F.col("buckets"))).drop("c", "buckets")
    sizes = dealt.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    # rows / bucket_rows + LEAST_BUCKETS * sources rows at most
    starts = sizes.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("source", "bucket").orderBy(*order)) - 1
    numbered = dealt.withColumn("within", within)
    return (
        numbered.join(F.broadcast(starts), numbered["source"].eqNullSafe(starts["s"]) & (numbered["bucket"] == starts["b"]))
        .select("source", "own", (F.col("within") + F.col("before")).alias("n"))
    )


def _plan(names: list, parts: dict, blocks: dict) -> Iterator[tuple]:
    """(source, first block, end, first place, places of a frame, weight, the source's places in it) of every phase and source."""
    shapes: dict[tuple, list[list[int]]] = {}
    for at, first, now, whole in phases(blocks, parts):
        active = [s for s in names if s in now]
        shape = tuple(now[s] for s in active)
        if shape not in shapes:
            shapes = {shape: frame(list(shape))}  # sources only leave, so no shape comes back
        for s, places in zip(active, shapes[shape]):
            yield s, first[s], min(blocks[s], first[s] + whole * now[s]), at, sum(shape), now[s], places


def mix(docs: DataFrame, weights: dict[str | None, int] | None = None, block_rows: int = 16, other_weight: int = 1, bucket_rows: int = 20_000) -> DataFrame:
    """Columns of docs, and block, slot, position: one row for each row of docs (doc_id, source, ...).

    position orders all rows from 0 without gaps between slots of equal size: slot is the
    block's place, position is slot * block_rows plus the row's number in the block, so
    the last, shorter block of a source leaves a gap. weights: integer parts of each
    source; others, null among them, have `other_weight`; only their proportions count. At every slot of a phase each
    source has had its share of the phase's slots to within one block.

    Which row of a source comes when follows a hash of doc_id, then doc_id, then a hash of the whole row; equal rows
    follow any order among themselves. Null doc_ids are rows like others. The
    counts of the sources, one number each, and the plan are worked out on the driver. Empty table: no rows. Columns named block, slot or
    position in docs are replaced; any other names may be used.
    """
    spark = docs.sparkSession
    weights = weights or {}
    kept = [c for c in docs.columns if c.lower() not in ("block", "slot", "position")]
    rows = _columns(docs, kept)
    counts = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count("*").alias("n")).collect()}
    names = sorted(counts, key=lambda s: (s is None, s or ""))
    parts = {s: int(weights.get(s, other_weight)) for s in names}
    if any(v < 1 for v in parts.values()):
        raise ValueError("weights are integers of at least 1")
    common = gcd(*parts.values()) if parts else 1
    parts = {s: v // common for s, v in parts.items()}
    blocks = {s: -(-counts[s] // block_rows) for s in names}
    told = list(_plan(names, parts, blocks))
    plan = spark.createDataFrame(told, "s string, first long, end long, at long, frame long, w long, places array<long>")
    if sum(len(p[-1]) for p in told) <= BROADCAST_PLACES:
        plan = F.broadcast(plan)
    numbered = number_rows(rows, counts, bucket_rows).withColumn("block", F.floor(F.col("n") / block_rows))
    slot = F.expr("at + ((block - first) div w) * frame + element_at(places, cast((block - first) % w as int) + 1)")
    return (
        numbered.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") >= F.col("first")) & (F.col("block") < F.col("end")))
        .withColumn("slot", slot)
        .select("own.*", "block", "slot", (F.col("slot") * block_rows + F.col("n") % block_rows).alias("position"))
    )
