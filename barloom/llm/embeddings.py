"""Near-duplicate vectors by Euclidean p-stable hashing.

A table's hash of a normalised vector is `width` quantised random projections
floor((a . x + b) / step). Cosine 0.9 is a distance of 0.447, at which one projection with
step 1.6 agrees with probability 0.78: with 8 projections and 40 tables a pair at the
threshold is missed with probability 0.003, closer pairs far less often. Equal vectors
are one representative with a count. Only ids are posted; buckets of one go, as do those with
the members of an earlier table's bucket, and vectors are joined to the rest. Members are compared exactly, in double
precision, in blocks of bounded size; a pair counts in the first table it shares, and the
largest set of members that met in one earlier bucket isn't multiplied again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, components, each_task, mix, prepare, spread, table

#: Vectors of a bucket in a block; a task holds two blocks. Pairs that are looked at together.
VECTORS, PAIRS = 2048, 1 << 19
#: Members of a bucket whose product is looked at before anything else is done.
SMALL = 256

_PLANES: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}


def _planes(dims: int, width: int, tables: int, step: float) -> tuple[np.ndarray, np.ndarray]:
    key = (dims, width, tables, step)
    if key not in _PLANES:
        rng = np.random.default_rng(20240607 + dims)
        _PLANES[key] = rng.standard_normal((dims, width * tables)) / step, rng.random(width * tables)
    return _PLANES[key]


def buckets(unit: np.ndarray, width: int, tables: int, step: float) -> np.ndarray:
    """One bucket number for each vector and table."""
    a, b = _planes(unit.shape[1], width, tables, step)
    cells = np.floor(unit @ a + b).astype(np.int64).astype(np.uint64).reshape(len(unit), tables, width)
    out = np.broadcast_to(mix(np.arange(1, tables + 1, dtype=np.uint64) + np.uint64(unit.shape[1] << 20)), cells.shape[:2]).copy()
    for k in range(width):
        out = mix(out ^ cells[:, :, k] * np.uint64(0x9E3779B97F4A7C15))
    return out.view(np.int64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither overflow nor underflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_size(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, their vectors as a matrix) for each size of the vectors, without copies into Python."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    at, flat = np.cumsum(size) - size, column.flatten().to_numpy(zero_copy_only=False)
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        yield rows, flat[at[rows][:, None] + np.arange(n)]


def _matrix(column: pa.ChunkedArray) -> np.ndarray | None:
    """The vectors of a bucket, or None if they are of unlike sizes, which meet by an accident of hashing only."""
    lists = column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()
    ends = lists.offsets.to_numpy()
    size = int(ends[1] - ends[0])
    if ends[-1] - ends[0] != size * len(lists) or (np.diff(ends) != size).any():
        return None
    return lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].reshape(-1, size)


def _hash(width: int, tables: int, step: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, vectors in _by_size(batch.column("embedding")):
                for lo in range(0, len(rows), 64):
                    part = rows[lo : lo + 64]
                    found = buckets(_unit(vectors[lo : lo + 64]), width, tables, step)
                    reps = batch.column("rep").take(pa.array(np.repeat(part, tables)))
                    numbers = pa.array(np.tile(np.arange(tables, dtype=np.int32), len(part)))
                    yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), reps, numbers], ["bucket", "rep", "table_no"])

    return run


def _joined(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest row of each row's component, once rows x are linked with rows y; label: before."""
    while len(x):
        a, b = label[x], label[y]
        apart = a != b
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        low = np.minimum(a, b)
        np.minimum.at(label, np.maximum(a, b), low)
        while (label[label] != label).any():
            label = label[label]
    return label


def _settled(own: np.ndarray, number: int) -> np.ndarray:
    """Of the rows' buckets, rows whose pairs with each other all lie in one bucket of an earlier table, and so were counted there: the largest such set."""
    best = np.zeros(len(own), bool)
    for k in range(number):
        values, at, n = np.unique(own[:, k], return_inverse=True, return_counts=True)
        if n.max() > best.sum():
            best = at == n.argmax()
    return best


def _compare(cosine: float, width: int, tables: int, step: float):
    def work(rows: pa.Table) -> pa.Table | None:
        """Per vector, how many others it links to in this block first; and links that span its components."""
        n, vectors = rows.num_rows, _matrix(rows.column("embedding"))
        if n < 2 or vectors is None:
            return None
        unit = _unit(vectors)
        if n <= SMALL and np.count_nonzero(unit @ unit.T >= cosine) <= n:  # each is near itself only, as in most buckets
            return None
        ids, block, copies = (rows.column(c).to_numpy() for c in ("rep", "_own", "copies"))
        number = rows.column("table_no")[0].as_py()
        cross = rows.column("_i")[0].as_py() != rows.column("_j")[0].as_py()
        own = buckets(unit, width, tables, step)[:, :number] if number else np.zeros((n, 0), np.int64)
        settled = _settled(own, number) if n > SMALL else np.zeros(n, bool)
        order = np.argsort(settled, kind="stable")  # rows that still have pairs among themselves come first
        ids, block, copies, unit, own = ids[order], block[order], copies[order], unit[order], own[order]
        label, count = np.arange(n), np.zeros(n, np.int64)
        open_rows, some_rows = n - int(settled.sum()), max(1, PAIRS // n)
        for lo in range(0, open_rows, some_rows):
            hi = min(lo + some_rows, open_rows)
            x, y = np.nonzero(unit[lo:hi] @ unit[lo:].T >= cosine)
            x, y = x + lo, y + lo
            keep = x < y
            if cross:
                keep &= block[x] != block[y]
            x, y = x[keep], y[keep]
            if number and len(x):
                first = ~(own[x] == own[y]).any(axis=1)
                x, y = x[first], y[first]
            count += np.bincount(x, copies[y], n).astype(np.int64) + np.bincount(y, copies[x], n).astype(np.int64)
            label = _joined(label, x, y)
        some, taken = np.flatnonzero(count), np.flatnonzero(label != np.arange(n))
        if not len(some):
            return None
        link = pa.table({"a": ids[taken], "b": pa.array(ids[label[taken]]), "n": np.zeros(len(taken), np.int64)})
        return pa.concat_tables([link, pa.table({"a": ids[some], "b": pa.nulls(len(some), pa.int64()), "n": count[some]})])

    return work


def near_vectors(
    vectors: DataFrame, cosine: float = 0.9, width: int = 8, hashes: int = 40, step: float = 1.6, block: int = VECTORS
) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of vectors (vec_id, embedding, ...).

    n_links counts the other rows at `cosine` or more; component_id is the smallest vec_id
    reachable, kept says whether it is the row's own. A vector that is null, empty, zero or
    holds null or non-finite components links with nothing, as do vectors of unlike sizes
    with each other. Null vec_id: links with nothing, component_id null, kept true. Repeated
    rows are copies, linked with each other. Other columns are not read. Empty table: no rows.
    """
    prepare(vectors.sparkSession)
    with Tables(vectors.sparkSession) as tables:
        return table(_near_vectors(vectors, cosine, width, hashes, step, block, tables), "near-vectors")


def _near_vectors(vectors: DataFrame, cosine: float, width: int, hashes: int, step: float, block: int, tables: Tables) -> DataFrame:
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"  # half the bytes to shuffle; compared as doubles
    kind = "array<float>" if single else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    sound = (
        F.col("vec_id").isNotNull()
        & F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    )
    groups = tables.write(rows.where(sound).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vectors")
    posted = groups.mapInArrow(_hash(width, hashes, step), "bucket long, rep long, table_no int")
    posted = tables.write(posted, "postings")
    # of buckets with the same members, told by 128 bits, the one of the first table: vectors that meet everywhere are compared once
    sets = posted.groupBy("bucket").agg(
        F.count("*").alias("size"), F.min("table_no").alias("table_no"), *(F.bit_xor(F.xxhash64(F.lit(k), F.col("rep"))).alias(f"h{k}") for k in (1, 2))
    ).where("size > 1")
    once = sets.groupBy("size", "h1", "h2").agg(F.min(F.struct("table_no", "bucket")).alias("first")).select("size", "first.bucket")
    members = spread(posted.join(once, "bucket"), "bucket", "rep", "size", block).join(groups, "rep")
    found = tables.write(
        each_task(members, _compare(cosine, width, hashes, step), "a long, b long, n long", ["rep", "copies", "embedding", "table_no", "_own"]), "near"
    )
    linked = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    settled = components(found.where("b is not null").select("a", "b"), tables).withColumnRenamed("id", "rep")
    of_group = (
        groups.join(linked, "rep", "left").join(settled, "rep", "left")
        .select("embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("comp", "rep").alias("top"))
    )
    good = rows.where(sound).join(of_group, "embedding").select("vec_id", F.col("n").alias("n_links"), F.col("top").alias("component_id"))
    bad = rows.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(bad).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
