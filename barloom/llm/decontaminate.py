"""Benchmark decontamination with one FM-index per training shard.

A shard is a run of documents of bounded length, coded as word numbers: a word of the
benchmark has its number, any other word and every end of a document is a terminator.
Terminators are distinct symbols ordered by position, so suffixes differ within the run
of benchmark words they begin with, and the suffix array is exact at a small cost.

Test phrases are searched backward, all at once, through the ranks of a wavelet matrix
over the Burrows-Wheeler transform. Occurrences are located from sampled suffix positions:
every SAMPLE-th position and every start of a run has one, so a walk never crosses a
terminator. Spans of all occurrences of a document are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, released, slices, table

#: Bytes that are no part of a word become spaces; A-Z become a-z. Bytes from 0x80 belong to words.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
SAMPLE = 16
#: Words of a shard, and bytes of text that are split into words before it is looked whether a shard is full.
SHARD_WORDS, PIECE = 1 << 19, 1 << 20


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Wavelet:
    """Wavelet matrix over symbols below 2 ** bits; rank by packed words and running counts."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        now = symbols
        for k in range(bits - 1, -1, -1):
            on = ((now >> k) & 1).astype(bool)
            packed = np.packbits(on, bitorder="little")
            packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)
            count = np.zeros(len(packed) + 1, np.int64)
            np.cumsum(np.bitwise_count(packed), out=count[1:])
            self.levels.append((packed, count, len(now) - int(count[-1])))
            now = np.concatenate([now[~on], now[on]])

    @staticmethod
    def _ones(packed: np.ndarray, count: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return count[word] + np.bitwise_count(below)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        lo, hi = np.zeros_like(at), at.copy()
        for k, (packed, count, zeros) in zip(range(self.bits - 1, -1, -1), self.levels):
            a, b = self._ones(packed, count, lo), self._ones(packed, count, hi)
            on = ((symbol >> k) & 1).astype(bool)
            lo, hi = np.where(on, zeros + a, lo - a), np.where(on, zeros + b, hi - b)
        return hi - lo

    def at(self, pos: np.ndarray) -> np.ndarray:
        """The symbols at positions."""
        out = np.zeros_like(pos)
        for packed, count, zeros in self.levels:
            on = ((packed[pos >> 6] >> (pos & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            ones = self._ones(packed, count, pos)
            out = (out << 1) | on
            pos = np.where(on, zeros + ones, pos - ones)
        return out


def suffix_array(codes: np.ndarray, bits: int) -> np.ndarray:
    """Order of all suffixes; 0 is a terminator, each one distinct and ordered by position, below all words."""
    n = len(codes)
    width = max(1, 60 // bits)
    padded = np.concatenate([codes, np.zeros(width, codes.dtype)])
    live = np.flatnonzero(codes)
    key = np.zeros(len(live), np.int64)
    going = np.ones(len(live), bool)
    for k in range(width):
        sym = np.where(going, padded[live + k], 0)
        going &= sym > 0
        key = (key << bits) | sym
    order = np.argsort(key, kind="stable")
    live, key, going = live[order], key[order], going[order]
    ends = np.flatnonzero(codes == 0)
    out = np.concatenate([ends, live])
    # rank: the first row of the group of suffixes that are not yet told apart
    fresh = np.ones(len(live), bool)
    fresh[1:] = (key[1:] != key[:-1]) | ~going[1:]
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(live)), 0)) + len(ends)
    rank = np.zeros(n + 1, np.int64)
    rank[ends] = np.arange(len(ends))
    rank[live] = first
    depth = width
    while True:
        alone = fresh & np.concatenate([fresh[1:], [True]])
        rows = np.flatnonzero(~alone)
        if not len(rows):
            return out
        at = out[len(ends) + rows]
        head, tail = rank[at], rank[np.minimum(at + depth, n)]
        again = np.lexsort((tail, head))
        at, head, tail = at[again], head[again], tail[again]
        out[len(ends) + rows] = at
        new = np.ones(len(rows), bool)
        new[1:] = (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])
        fresh[rows] = new
        rank[at] = np.maximum.accumulate(np.where(new, rows, 0)) + len(ends)
        depth *= 2


class FMIndex:
    def __init__(self, codes: np.ndarray, n_symbols: int):
        bits = max(1, int(n_symbols).bit_length())
        order = suffix_array(codes, bits)
        before = np.where(order > 0, codes[order - 1], 0)
        self.wavelet = Wavelet(before, bits)
        self.starts = np.zeros(n_symbols + 2, np.int64)
        np.cumsum(np.bincount(codes, minlength=n_symbols + 1), out=self.starts[1:])
        kept = (order % SAMPLE == 0) | (before == 0)
        self.marks = Wavelet(kept.astype(np.int64), 1)
        self.samples = order[kept]
        self.n = len(codes)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of all phrases (right-aligned, padded on the left with 0)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        width = phrases.shape[1]
        for k in range(width):
            rows = np.flatnonzero((lengths > k) & (lo < hi))
            if not len(rows):
                break
            sym = phrases[rows, width - 1 - k]
            lo[rows] = self.starts[sym] + self.wavelet.rank(sym, lo[rows])
            hi[rows] = self.starts[sym] + self.wavelet.rank(sym, hi[rows])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows."""
        out, steps = np.empty(len(rows), np.int64), 0
        at, todo = rows.copy(), np.arange(len(rows))
        one = np.ones(1, np.int64)
        while len(todo):
            found = self.marks.at(at).astype(bool)
            which = self.marks.rank(np.broadcast_to(one, at[found].shape), at[found])
            out[todo[found]] = self.samples[which] + steps
            at, todo = at[~found], todo[~found]
            sym = self.wavelet.at(at)
            at = self.starts[sym] + self.wavelet.rank(sym, at)
            steps += 1
        return out


class Phrases:
    """The distinct windows of some benchmark items, coded with a vocabulary of their own: rows of word numbers,
    right-aligned, and the items of each row."""

    def __init__(self, items: list[tuple[object, bytes]], window: int):
        self.code: dict[bytes, int] = {}
        self.names = ["" if i is None else str(i) for i, _ in items]
        parts, owners = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int64)]
        for k, (_, text) in enumerate(items):
            ids = np.array([self.code.setdefault(w, len(self.code) + 1) for w in words_of(text)], np.int32)
            if len(ids) >= window:
                part = np.lib.stride_tricks.sliding_window_view(ids, window)
            else:
                part = np.concatenate([np.zeros(window - len(ids), np.int32), ids])[None, :][: len(ids)]
            parts.append(part)
            owners.append(np.full(len(part), k))
        every, owner = np.concatenate(parts), np.concatenate(owners)
        self.rows, same = np.unique(every, axis=0, return_inverse=True)
        self.lengths = (self.rows > 0).sum(axis=1)
        order = np.argsort(same.ravel(), kind="stable")
        self.owner = owner[order]
        self.owner_at = np.searchsorted(same.ravel()[order], np.arange(len(self.rows) + 1))

    def coded(self, words: list[bytes]) -> np.ndarray:
        """The words' numbers, 0 for those of no window."""
        return np.fromiter(map(self.code.get, words, repeat(0)), np.int32, len(words))

    def items(self, row: int) -> list[str]:
        return [self.names[k] for k in self.owner[self.owner_at[row] : self.owner_at[row + 1]].tolist()]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def shard_hits(docs: list[np.ndarray] | list[list[bytes]], phrases: Phrases) -> list[tuple[list[tuple[int, int]], set[str]]]:
    """For each document of a shard, its words or their numbers: merged spans of word numbers, and items with an occurring window."""
    coded = [d if isinstance(d, np.ndarray) else phrases.coded(d) for d in docs]
    at = np.zeros(len(docs) + 1, np.int64)
    np.cumsum([len(d) + 1 for d in coded], out=at[1:])
    codes = np.zeros(at[-1], np.int64)  # 0 after every document
    for d, lo in zip(coded, at.tolist()):
        codes[lo : lo + len(d)] = d
    out: list[tuple[list, set]] = [([], set()) for _ in docs]
    if not len(phrases.rows) or not codes.any():
        return out
    index = FMIndex(codes, len(phrases.code))
    lo, hi = index.search(phrases.rows, phrases.lengths)
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    starts = index.locate(rows)
    of = np.searchsorted(at, starts, side="right") - 1
    for d, s, p in zip(of.tolist(), (starts - at[of]).tolist(), which.tolist()):
        out[d][0].append((s, s + int(phrases.lengths[p])))
        out[d][1].update(phrases.items(p))
    return [(_merged(spans), items) for spans, items in out]


_SPANS = "spans array<struct<lo:long,hi:long>>, items array<string>"


def _arrays(found: list[tuple[list[tuple[int, int]], set[str]]]) -> list[pa.Array]:
    spans = [[{"lo": a, "hi": b} for a, b in part] for part, _ in found]
    return [pa.array(spans, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), pa.array([sorted(x) for _, x in found], pa.list_(pa.string()))]


def _shards(batches: Iterator[pa.RecordBatch], phrases: Phrases, shard_words: int) -> Iterator[list[tuple[pa.RecordBatch, list[np.ndarray]]]]:
    """Rows and the numbers of their words, in runs of about shard_words words: a run holds little more, or one text."""
    held: list[tuple[pa.RecordBatch, list[np.ndarray]]] = []
    total = 0
    for batch in batches:
        sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
        for lo, hi in slices(sizes, PIECE):
            part = batch.slice(lo, hi - lo)
            coded = [phrases.coded(words_of(t or b"")) for t in part.column("text").cast(pa.binary()).to_pylist()]
            held.append((part, coded))
            total += sum(map(len, coded))
            if total >= shard_words:
                yield held
                held, total = [], 0
    if held:
        yield held


def _search(phrases, shard_words: int, every: bool):
    """The columns of the rows but for text, n_words, spans and items; without `every`, of rows with a hit only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _shards(batches, phrases.value, shard_words):
            found = iter(shard_hits([d for _, coded in held for d in coded], phrases.value))
            for batch, coded in held:
                own = [next(found) for _ in coded]
                names = [n for n in batch.schema.names if n != "text"]
                out = pa.RecordBatch.from_arrays(
                    [*(batch.column(n) for n in names), pa.array([len(d) for d in coded], pa.int64()), *_arrays(own)], [*names, "n_words", "spans", "items"]
                )
                yield out if every else out.filter(pa.array([bool(s) for s, _ in own], pa.bool_()))

    return run


def _blocks(benchmark: DataFrame, block_chars: int, window: int) -> Iterator[Phrases]:
    """The windows of the benchmark in blocks of at most about block_chars characters."""
    items = benchmark.where("text is not null").select("item_id", "text")
    n = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield Phrases([(r["item_id"], r["text"].encode()) for r in part.collect()], window)


def _hits(rows: DataFrame, benchmark: DataFrame, window: int, block_chars: int, shard_words: int) -> DataFrame:
    """doc_id, row, n_words, spans, items of every row of rows (doc_id, row, text). One block of the benchmark is one
    pass over the texts. More are as many, which all read the same rows and send on what they hit; it is merged by row."""
    spark = rows.sparkSession
    schema = f"doc_id long, row long, n_words long, {_SPANS}"
    passes = [rows.mapInArrow(released(_search(spark.sparkContext.broadcast(p), shard_words, k == 0)), schema) for k, p in enumerate(_blocks(benchmark, block_chars, window))]
    if len(passes) == 1:
        return passes[0]
    every = reduce(DataFrame.union, passes)
    both = every.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return both.select("doc_id", "row", "n_words", merged("spans").alias("spans"), "items")


def merged(spans: str) -> Column:
    """Sorted spans with those that touch or overlap joined."""
    none = F.array().cast("array<struct<lo:bigint,hi:bigint>>")

    def step(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], s["hi"]).alias("hi"))))
        return F.when((F.size(done) > 0) & (s["lo"] <= F.try_element_at(done, F.lit(-1))["hi"]), joined).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(spans, none, step)


def _rows(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text", *more)


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_chars: int = 4_000_000, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, spans, items: one row for each row of docs.

    A window is `window` consecutive words of an item, or all words of a shorter item.
    spans: merged [lo, hi) ranges of the document's word numbers inside occurrences;
    items: the item_ids, as strings, with an occurring window, sorted.

    The benchmark is broadcast in blocks of at most about `block_chars` characters, each a pass over the documents. With
    more than one block the rows are first written to the shared folder with a number each. Null text: no words. Null or empty items: no windows. A null
    item_id counts as the empty string. Repeated rows each get their answer. Other
    columns are not read. Empty tables: no rows, or no hits.
    """
    prepare(docs.sparkSession)
    rows = _rows(docs)
    if _many(benchmark, block_chars):
        rows = table(rows, "leak-rows")
    return _hits(rows, benchmark, window, block_chars, shard_words).select("doc_id", "n_words", "spans", "items")


def _many(benchmark: DataFrame, block_chars: int) -> bool:
    return (benchmark.agg(F.sum(F.length("text"))).first()[0] or 0) > block_chars


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, rest: the text without its spans, null if no word is left."""
    for batch in batches:
        out = []
        for text, spans, n in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), batch.column("n_words").to_pylist()):
            gone = [(s["lo"], s["hi"]) for s in spans]
            out.append(cut_spans(text, gone).decode() if sum(b - a for a, b in gone) < n else None)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], ["row", "rest"])


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, cut: bool = False, block_chars: int = 4_000_000, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """The rows of docs without an occurrence of a window; all columns stay.

    With cut, a document stays without the words of its merged spans, and is dropped only
    if no word is left. Nulls and repeated rows as in find_leaks.
    """
    spark = docs.sparkSession
    prepare(spark)
    if not cut and not _many(benchmark, block_chars):  # one pass that drops rows as it finds them
        shared = spark.sparkContext.broadcast(next(_blocks(benchmark, block_chars, window)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for held in _shards(batches, shared.value, shard_words):
                found = iter(shard_hits([d for _, coded in held for d in coded], shared.value))
                for batch, _ in held:
                    yield batch.filter(pa.array([not next(found)[0] for _ in range(batch.num_rows)], pa.bool_()))

        return docs.mapInArrow(released(run), docs.schema)
    # the rows travel as one column, so that none of theirs can be taken for ours
    rows = table(_rows(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")), "leak-rows")
    hit = table(_hits(rows.select("doc_id", "row", "text"), benchmark, window, block_chars, shard_words).where(F.size("spans") > 0).drop("doc_id"), "leaks")
    if not cut:
        return rows.join(hit, "row", "left_anti").select("whole.*")
    rest = rows.select("row", "text").join(hit, "row").select("row", "text", "spans", "n_words").mapInArrow(released(_cut_texts), "row long, rest string").withColumn("found", F.lit(True))
    new = rows.join(rest, "row", "left").where("found is null or rest is not null")
    return new.select(*((F.coalesce("rest", F.col("whole").getField(c)) if c == "text" else F.col("whole").getField(c)).alias(c) for c in docs.columns))


def n_hit(spans: str = "spans") -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"])


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans; each cut leaves a line break."""
    folded, out, pos, word, last, k = text.translate(_FOLD), [], 0, 0, 0, 0
    n = len(text)
    while k < len(spans):
        while pos < n and folded[pos] == 32:
            pos += 1
        if word == spans[k][0]:
            out.append(text[last:pos])
        while pos < n and folded[pos] != 32:
            pos += 1
        word += 1
        if word == spans[k][1]:
            last, k = pos, k + 1
    return b"\n".join([*out, text[last:]])

