"""MinHash near-duplicates by a signature-coordinate inverted join.

Every distinct shingle set gets `coords` MinHash values and is posted under each
(coordinate, value). Two sets of similarity s agree in about s * coords coordinates;
those that collide in at least `matches` postings are candidates. With coords 32 and
matches 13 a pair at the threshold 0.8 is missed with a probability below 1e-6.

Prefix: coordinates of a set are ordered by how many sets share their value. Two sets
with `matches` collisions must meet in the first coords - matches + 1 of them, so only
those are posted, and the postings of boilerplate, shared by far more sets, never are.

Counting: a task holds the members of a posting, in blocks, and inverts their signatures.
For each set the shortest coords - matches + 1 of its lists are merged and the collisions
counted; the matches - 1 longest lists are skipped, only sets met in a shorter one are looked
up in them. A list is passed over, too, if it holds nothing but sets that are connected to
this one already, so a posting of n sets yields at most n - 1 links, not n * n pairs.

Candidates are then confirmed on the full sets, by the same counting in blocks of bounded
size, again without work on pairs that others have connected. Shingles are told apart by 64-bit hashes
without a pattern, equal sets by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK, Members, Tables, bloom_of, components, distinct_groups, group_links, mix, prepare, released, slices, space_words, table, utf8

#: Sets of a task up to which their signatures are compared as they are.
SMALL = 24

_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _steps(width: int) -> np.ndarray:
    return mix(np.arange(1, width + 1, dtype=np.uint64) * _STEP[0])


def shingle_sets(text: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text, in order."""
    data, offsets = utf8(text)
    steps = _steps(width)
    for lo, hi in slices(offsets):
        base = offsets[lo]
        words, at = space_words(data[base : offsets[hi]], offsets[lo : hi + 1] - base)
        n = len(words)
        rolled = np.zeros(max(0, n - width + 1), np.uint64)
        for k in range(width):
            rolled += mix(words[k : k + len(rolled)] ^ steps[k])
        rolled = mix(rolled)
        for i in range(hi - lo):
            a, b = at[i], at[i + 1]
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:  # fewer words: the whole sequence is one shingle, told apart by its length
                whole = np.add.reduce(mix(words[a:b] ^ steps[: b - a]), keepdims=True)
                yield mix(whole ^ np.uint64(0xA5A5 + b - a))
            else:
                yield words[:0]


def signatures(sets: list[np.ndarray], coords: int) -> np.ndarray:
    """One row of `coords` MinHash values for each set; sets are not empty."""
    at = np.zeros(len(sets), np.int64)
    np.cumsum([len(s) for s in sets[:-1]], out=at[1:])
    flat = np.concatenate(sets)
    out = np.empty((len(sets), coords), np.int64)
    for k, seed in enumerate(mix(np.arange(101, 101 + coords, dtype=np.uint64))):
        h = (flat ^ seed) * _STEP[1]
        h ^= h >> np.uint64(32)
        h *= _STEP[2]
        out[:, k] = (np.minimum.reduceat(h, at) >> np.uint64(1)).astype(np.int64)
    return out


def _key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sketch(width: int, coords: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column("text"), width))
            full = [s for s in sets if len(s)]
            sigs = iter(signatures(full, coords) if full else ())
            rows = [next(sigs) if len(s) else None for s in sets]
            keys = [_key(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(rows, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_key", "sig"],
            )

    return run


class Lists:
    """The inverted signatures of a task's sets: for each coordinate, the sets in order of their values."""

    def __init__(self, sig: np.ndarray, matches: int):
        self.sig, self.matches = sig, matches
        if len(sig) <= SMALL:
            return
        n = len(sig)
        self.order = np.argsort(sig, axis=0, kind="stable")
        ranked = np.take_along_axis(sig, self.order, axis=0)
        edge = np.ones((n + 1, sig.shape[1]), bool)
        edge[1:n] = ranked[1:] != ranked[:-1]
        at = np.arange(n + 1)[:, None]
        #: Of each set and coordinate: where its list begins and ends in order.
        self.low, self.high = np.empty(sig.shape, np.int64), np.empty(sig.shape, np.int64)
        np.put_along_axis(self.low, self.order, np.maximum.accumulate(np.where(edge, at, 0), axis=0)[:n], axis=0)
        np.put_along_axis(self.high, self.order, np.minimum.accumulate(np.where(edge, at, n)[::-1], axis=0)[::-1][1:], axis=0)

    def collisions(self, x: int, members: Members) -> tuple[np.ndarray, np.ndarray]:
        """(sets, collisions): those that x is to be compared with and shares `matches` lists with, most collisions first."""
        if len(self.sig) <= SMALL:  # lists this short are counted at once
            rest = np.arange(x + 1, len(self.sig))
            rest = rest[members.pairs(x, rest)]
            count = (self.sig[rest] == self.sig[x]).sum(axis=1)
            enough = np.flatnonzero(count >= self.matches)
            enough = enough[np.argsort(-count[enough], kind="stable")]
            return rest[enough], count[enough]
        size = self.high[x] - self.low[x]
        lists = np.argsort(size, kind="stable")
        short, long = lists[: len(lists) - self.matches + 1], lists[len(lists) - self.matches + 1 :]
        met = [self.order[self.low[x, k] : self.high[x, k], k] for k in short[size[short] > 1]]
        met = [part for part in met if (members.trees.of[part] != members.trees.of[x]).any()]
        if not met:
            return lists[:0], lists[:0]
        other, count = np.unique(np.concatenate(met), return_counts=True)
        counts = (other > x) & members.pairs(x, other)  # a pair is seen from its first row
        mine, count = other[counts], count[counts]
        # lists passed over above hold none of these, but skipped ones may
        count = count + (self.sig[np.ix_(mine, long)] == self.sig[x, long]).sum(axis=1)
        enough = np.flatnonzero(count >= self.matches)
        enough = enough[np.argsort(-count[enough], kind="stable")]
        return mine[enough], count[enough]


def _signatures_of(rows: pa.Table) -> np.ndarray:
    return rows.column("sig").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)


def _candidates(matches: int):
    def work(rows: pa.Table) -> pa.Table | None:
        """Links between the sets of a posting that collide in enough coordinates."""
        members = Members(rows)
        lists = Lists(_signatures_of(rows), matches) if members.trees.count > 1 else None
        for x in range(len(members)):
            if members.trees.count == 1:
                break
            for y in lists.collisions(x, members)[0].tolist():
                members.trees.join(x, y)
        return members.done()

    return work


def _confirm(matches: int, percent: int):
    def work(rows: pa.Table) -> pa.Table | None:
        """Links of the task whose full sets have 100 * intersection >= percent * union."""
        members = Members(rows)
        if members.trees.count == 1:
            return None
        lists = Lists(_signatures_of(rows), matches)
        flat = rows.column("shingles").combine_chunks()
        values, at = flat.flatten().to_numpy(), np.concatenate([[0], np.cumsum(rows.column("shingles").combine_chunks().value_lengths().to_numpy())])
        sizes = np.diff(at)
        for x in range(len(members)):
            if members.trees.count == 1:
                break
            near, _ = lists.collisions(x, members)
            near = near[100 * np.minimum(sizes[near], sizes[x]) >= percent * np.maximum(sizes[near], sizes[x])]
            for y in near.tolist():
                if members.trees.of[x] == members.trees.of[y]:
                    continue
                both = len(np.intersect1d(values[at[x] : at[x + 1]], values[at[y] : at[y + 1]], assume_unique=True))
                if 100 * both >= percent * (sizes[x] + sizes[y] - both):
                    members.trees.join(x, y)
        return members.done()

    return work


def _sets_of(width: int, bits):
    """The sets of the documents that a Bloom filter lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bits.value
        for batch in batches:
            spot = batch.column("spot").to_numpy()
            hit = (words[spot >> 6] >> (spot & 63).astype(np.uint64)) & np.uint64(1)
            part = batch.filter(pa.array(hit.astype(bool)))
            sets = list(shingle_sets(part.column("text"), width)) if part.num_rows else []
            keys = [_key(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(keys, pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc_id", "set_key", "shingles"]
            )

    return run


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, coords: int = 32, matches: int = 13, block: int = BLOCK
) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, n_shingles, component_id, kept: one row for each row of docs.

    Words are split at ASCII white space after lower-casing A-Z; a shingle is `width`
    consecutive words, or the whole text if it has fewer. Documents are linked if their
    sets have 100 * intersection >= percent * union; component_id is the smallest doc_id
    reachable through links, kept says whether it is the row's own.

    Null or blank text: n_shingles 0, linked with nothing. Null doc_id: component_id null,
    kept true, linked with nothing. Repeated rows have the same answer. Rows that share a
    doc_id but not a text are judged by their own text; if that doc_id is the smallest of
    several sets it joins them. Other columns are not read. Empty table: no rows.
    """
    prepare(docs.sparkSession)
    with Tables(docs.sparkSession) as tables:
        return _near_duplicates(docs, width, percent, coords, matches, block, tables)


def _near_duplicates(docs: DataFrame, width: int, percent: int, coords: int, matches: int, block: int, tables: Tables) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = tables.write(
        rows.mapInArrow(released(_sketch(width, coords)), "doc_id long, n_shingles long, set_key binary, sig array<long>"), "sketch"
    )
    # Equal sets first: copies of one text are one representative from here on.
    groups = tables.write(
        sketched.where("set_key is not null and doc_id is not null")
        .groupBy("set_key")
        .agg(F.min("doc_id").alias("rep"), F.min_by("sig", "doc_id").alias("sig")),
        "groups",
    )
    posted = groups.select("set_key", F.posexplode("sig").alias("coord", "value"))
    common = posted.groupBy("coord", "value").agg(F.count("*").alias("freq")).where("freq > 1")
    prefix = (
        posted.join(common, ["coord", "value"])
        .groupBy("set_key")
        .agg(F.sort_array(F.collect_list(F.struct("freq", "coord", "value"))).alias("shared"))
        # values of frequency 1 come first in the order and take their places in the prefix
        .withColumn("take", F.lit(coords - matches + 1) - (F.lit(coords) - F.size("shared")))
        .where("take > 0")
        .select("set_key", F.explode(F.slice("shared", F.lit(1), F.col("take"))).alias("p"))
        .select("set_key", F.xxhash64("p.coord", "p.value").alias("group"))
    )
    # sets that are near meet in most of their postings: those with the same members are one
    lists = distinct_groups(tables.write(prefix, "prefix"), "set_key")
    lists = tables.write(lists.join(groups, "set_key").select("group", F.col("rep").alias("node"), "sig"), "lists")
    found = group_links(lists, _candidates(matches), ["sig"], tables, block)
    loose = tables.write(components(found, tables), "loose")
    tables.drop(lists)
    # Full sets of the candidates only: a Bloom filter of bounded size thins the texts, an exact join takes the others out.
    bits = bloom_of(loose, "id")
    full = (
        rows.where("doc_id is not null")
        .withColumn("spot", F.pmod(F.xxhash64(F.lit(5), F.col("doc_id")), F.lit(len(bits) * 64)))
        .mapInArrow(released(_sets_of(width, spark.sparkContext.broadcast(bits))), "doc_id long, set_key binary, shingles array<long>")
        .where("set_key is not null")
        .join(loose.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
        .groupBy("set_key")
        .agg(F.first("shingles").alias("shingles"))
    )
    members = full.join(groups, "set_key").join(loose.withColumnRenamed("id", "rep"), "rep")
    members = tables.write(members.select(F.col("comp").alias("group"), F.col("rep").alias("node"), "sig", "shingles"), "members")
    links = group_links(members, _confirm(matches, percent), ["sig", "shingles"], tables, block)
    settled = components(links, tables)
    of_set = groups.select("set_key", "rep").join(settled.withColumnRenamed("id", "rep"), "rep", "left")
    of_set = of_set.select("set_key", F.coalesce("comp", "rep").alias("top"))
    out = sketched.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key"))
    with_set = out.where("set_key is not null").join(of_set, "set_key")
    alone = out.where("set_key is null").withColumn("top", F.col("doc_id"))
    judged = with_set.select("doc_id", "n_shingles", "top").union(alone.select("doc_id", "n_shingles", "top"))
    return table(
        judged.select("doc_id", "n_shingles", F.col("top").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("top"), F.lit(True)).alias("kept")),
        "near-duplicates",
    )


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each near-duplicate group, the one with the smallest doc_id; all columns stay.

    Rows without a doc_id or words stay; rows that share a doc_id stay or go together.
    """
    judged = near_duplicates(docs, width, percent).where("doc_id is not null")
    gone = judged.groupBy("doc_id").agg(F.max("kept").alias("any")).where("not any").select("doc_id")
    # the rows travel as one column, so that none of theirs can be taken for the join's
    row = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return row.join(gone, "doc_id", "left_anti").select("row.*")
