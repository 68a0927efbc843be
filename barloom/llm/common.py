"""Shared pieces of the training-data operators.

Nothing here knows about a single operator: shared-folder tables, connected
components, pairwise work inside groups of any size, and byte-level text
arithmetic on numpy arrays.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Rows of an Arrow batch. Documents may be long, so batches stay short.
BATCH_ROWS = 256
#: Members of a group that one task compares with each other at most.
BLOCK = 512

#: Rows of short tasks that are held before work begins, in bytes.
HELD_BYTES = 16 << 20

_own_dir: list[str] = []
_left: list[str] = []


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches by rows, since whole documents travel in them; workers get the package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, whose Python worker gives back what it no longer uses when a task ends. Workers wait for other
    stages' tasks, several for each core, and would keep the most that any task before had taken."""

    def then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
            if trim:
                trim(0)

    return then


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a local master gets a folder of
    its own, removed at exit; a cluster, whose machines share none, is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    if not _own_dir:
        path = tempfile.mkdtemp(prefix="barloom-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _own_dir.append("file://" + path)
    return _own_dir[0]


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/barloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def table(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as Parquet to the shared folder and read it again.

    A lost executor then costs a re-read, not a recomputation of everything before. The table stays, for the result that reads it, see Leftovers.
    """
    out, path = _written(df, name)
    _left.append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Leftovers:
    """Tables that operators leave for their results; those left inside a `with` go at its end, where what read them is written."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> Leftovers:
        self.begin = len(_left)
        return self

    def __exit__(self, *_) -> None:
        while len(_left) > self.begin:
            _delete(self.spark, _left.pop())


class Tables:
    """The tables of one run in the shared folder; those that its result doesn't read go when the run ends, however it ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_) -> None:
        for df in list(self.paths):
            self.drop(df)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """A table that goes with the run."""
        out, path = _written(df, name)
        self.paths[out] = path
        return out

    def keep(self, df: DataFrame) -> None:
        """Leaves a table where it is: the run's result reads it."""
        _left.append(self.paths.pop(df))

    def drop(self, df: DataFrame) -> None:
        _delete(self.spark, self.paths.pop(df))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def thinned(count: int, wanted: int) -> int:
    """Hashes below this, as non-negative longs, pass about four times `wanted` of `count` rows, or all.

    A filter by it leaves few rows to sort for a bounded sample, from however many tasks.
    """
    share = min(1.0, (4 * wanted + 100) / max(1, count))
    return (1 << 63) - 1 if share >= 1 else int(share * (1 << 63))


# --- connected components ---------------------------------------------------


def components(edges: DataFrame, tables: Tables, max_rounds: int = 40) -> DataFrame:
    """(a, b) edges of bigint ids -> (id, comp): comp is the smallest id reachable.

    Alternating large-star and small-star steps; every step is a min-aggregation and
    a join on the node, so a hub is split by partial aggregation and skew joins.
    Each round is written to the shared folder and replaces the one before; rounds end when all
    components are stars. Nodes without an edge are absent.
    """
    low_high = (F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = tables.write(edges.where("a <> b").select(*low_high).distinct(), "edges")
    for _ in range(max_rounds):
        if _only_stars(now):
            break
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, now = now, tables.write(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        tables.drop(old)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("comp")).union(
        now.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct()
    )


def _only_stars(edges: DataFrame) -> bool:
    """Whether every a has one b, and no b is an a: all edges lead to the smallest id of their component."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("top")).union(
        edges.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("top"))
    )
    node = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("top").alias("top"))
    return node.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("top") > 0))).limit(1).count() == 0


class Forest:
    """Union-find over row numbers of one block; keeps the links that joined two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.links.append((x, y))


# --- pairwise work inside groups of any size ----------------------------------


def spread(df: DataFrame, group: str, member: str, size: str, block: int = BLOCK) -> DataFrame:
    """Deal the members of each group to tasks (_g, _i, _j) that together see every pair.

    A group of up to `block` members is one task. A larger one is cut into blocks by a
    hash of the member, and each pair of blocks is a task: no task holds more than about
    two blocks, whatever the group's size. `size` is an upper bound of the group's size.
    Adds _own: the block of the row.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col(size) / F.lit(block))).cast("int")
    own = F.pmod(F.xxhash64(F.lit(11), F.col(member)), F.col("_n")).cast("int")
    return (
        df.withColumn("_n", parts)
        .withColumn("_own", own)
        .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .withColumn("_g", F.col(group))
        .withColumn("_i", F.least("_own", "_o"))
        .withColumn("_j", F.greatest("_own", "_o"))
        .drop("_o", "_n")
    )


class Trees:
    """The trees that links have joined rows into, as a flat label of each row."""

    def __init__(self, roots: np.ndarray):
        self.roots, self.of = np.unique(roots, return_inverse=True)
        self.first = self.of.copy()
        self.count = len(self.roots)

    def join(self, x: int, y: int) -> None:
        p, q = self.of[x], self.of[y]
        if p != q:
            self.of[self.of == q] = p
            self.count -= 1

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        """(a, b): each root that a tree has taken in, and the smallest root of the tree."""
        tree = np.empty(len(self.roots), np.int64)
        tree[self.first] = self.of
        low = np.full(len(self.roots), np.iinfo(np.int64).max)
        np.minimum.at(low, tree, self.roots)
        low = low[tree]
        taken = low != self.roots
        return self.roots[taken], low[taken]


class Members:
    """The rows of one task of group_links: nodes, the trees they are in, and which pairs are this task's."""

    def __init__(self, rows: pa.Table):
        self.node = rows.column("node").to_numpy()
        self.trees = Trees(rows.column("_root").to_numpy())
        self.cross = rows.column("_j")[0].as_py() >= 0
        self.visits = rows.column("_visits").to_numpy(zero_copy_only=False)
        self.loose = rows.column("_loose").to_numpy(zero_copy_only=False)

    def __len__(self) -> int:
        return len(self.node)

    def pairs(self, x: int, y: np.ndarray) -> np.ndarray:
        """Whether x and each of the rows y are in different trees and, between blocks, a visitor and a resident;
        two loose members meet twice there, and only the visit of the smaller node counts."""
        open_ = self.trees.of[y] != self.trees.of[x]
        if not self.cross:
            return open_
        visitor, resident = (x, y) if self.visits[x] else (y, x)
        return open_ & (self.visits[y] != self.visits[x]) & (~self.loose[resident] | (self.node[visitor] < self.node[resident]))

    def done(self) -> pa.Table | None:
        """Links from the nodes to the smallest of their tree, the same ones from every task that finds this tree."""
        a, b = self.trees.stars()
        return pa.table({"a": a, "b": b}) if len(a) else None


def distinct_groups(members: DataFrame, by: str) -> DataFrame:
    """members (group, by, ...) without groups of one, and with one of the groups that have the same members, told by 128 bits."""
    same = members.groupBy("group").agg(
        F.count("*").alias("n"), *(F.bit_xor(F.xxhash64(F.lit(k), F.col(by))).alias(f"h{k}") for k in (1, 2))
    ).where("n > 1")
    one = same.groupBy("n", "h1", "h2").agg(F.min("group").alias("group")).select("group")
    return members.join(one, "group", "left_semi")


def group_links(members: DataFrame, work: Callable[[pa.Table], pa.Table | None], payload: list[str], tables: Tables, block: int = BLOCK) -> DataFrame:
    """(a, b): links that span the components of what `work` would link among all pairs of a group's members.

    members: a written table of (group, node, payload...), bigint group and node. A group of up to `block`
    members is one task. A larger one is dealt to blocks by a hash of the node, and after
    the work inside blocks only pairs that lie in two of the components found so far remain. So members
    outside a group's largest component, its loose ones, visit every block: the group's n members are
    copied once for every `block` of its m loose ones, and these once for every block,
    n * m / block rows of both, and none if the blocks' links connect the group. A task holds about two blocks.
    """
    size = members.groupBy("group").agg(F.count("*").alias("size"))
    big = tables.write(size.where(F.col("size") > block), "big")
    blocks = F.ceil(F.coalesce("size", F.lit(1)) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(F.lit(11), F.col("node")), blocks).cast("int")
    sized = members.join(big, "group", "left").select("group", "node", *payload, own.alias("_i"), blocks.alias("_blocks"))
    none = (F.col("node").alias("_root"), F.lit(False).alias("_visits"), F.lit(False).alias("_loose"))
    columns = ["node", "_root", "_visits", "_loose", *payload]
    inside = each_task(sized.select("*", F.col("group").alias("_g"), F.lit(-1).alias("_j"), *none), work, "a long, b long", columns)
    inside = tables.write(inside, "links")
    if big.isEmpty():
        return inside
    rooted = tables.write(components(inside, tables), "roots")
    found = rooted.select(F.col("id").alias("a"), F.col("comp").alias("b"))  # stands for the links inside blocks
    rooted = rooted.withColumnRenamed("id", "node").withColumnRenamed("comp", "root")
    placed = sized.where("_blocks > 1").join(rooted, "node", "left").withColumn("root", F.coalesce("root", "node"))
    parts = placed.groupBy("group", "root").agg(F.count("*").alias("n"))
    most = parts.groupBy("group").agg(F.max_by("root", F.struct("n", "root")).alias("main"), (F.sum("n") - F.max("n")).alias("loose"))
    open_ = tables.write(most.where("loose > 0"), "open")
    if open_.isEmpty():
        return found
    placed = placed.join(open_, "group").withColumn("_loose", F.col("root") != F.col("main"))
    guests = F.ceil(F.col("loose") / F.lit(block)).cast("int")
    seat = F.pmod(F.xxhash64(F.lit(13), F.col("node")), guests).cast("int")
    residents = placed.withColumn("_j", F.explode(F.sequence(F.lit(0), guests - 1))).withColumn("_visits", F.lit(False))
    visitors = placed.where("_loose").withColumn("_j", seat).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).withColumn("_visits", F.lit(True))
    both = residents.unionByName(visitors).withColumn("_g", F.col("group")).withColumn("_root", F.col("root"))
    return found.union(tables.write(each_task(both, work, "a long, b long", columns), "links"))


def each_task(
    df: DataFrame, work: Callable[[pa.Table], pa.Table | None], schema: str, names: list[str]
) -> DataFrame:
    """Run `work` on the rows of each (_g, _i, _j); one pass over sorted partitions, one task's rows in memory."""
    keys = ["_g", "_i", "_j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n_held = 0
        out: list[pa.Table] = []

        def flush(last: bool) -> None:
            """Works on the tasks that are all here; the last one may go on, and stays."""
            nonlocal n_held
            rows = pa.Table.from_batches(held).combine_chunks()
            cols = [rows.column(k).to_numpy() for k in keys]
            change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
            bounds = [0, *change.tolist(), rows.num_rows]
            for lo, hi in zip(bounds, bounds[1:] if last else bounds[1:-1]):
                found = work(rows.slice(lo, hi - lo)) if hi - lo > 1 else None
                if found is not None and found.num_rows:
                    out.append(found)
            held.clear()
            n_held = 0
            if not last:
                held.extend(rows.slice(bounds[-2]).to_batches())
                n_held = rows.num_rows - bounds[-2]

        limit, size = 4096, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n_held += batch.num_rows
            size += batch.nbytes
            if n_held >= limit or size >= HELD_BYTES:
                flush(False)
                limit, size = max(4096, 2 * n_held), 0  # a long task is not looked through again and again
                if out:
                    yield from pa.concat_tables(out).combine_chunks().to_batches()
                    out.clear()
        if held:
            flush(True)
        if out:
            yield from pa.concat_tables(out).combine_chunks().to_batches()

    return (
        df.select(*keys, *names)
        .repartition(*keys)  # as many partitions as the bytes and cores call for
        .sortWithinPartitions(*keys)
        .mapInArrow(released(run), schema)
    )


# --- a Bloom filter of ids, of bounded size ---------------------------------


def bloom_of(ids: DataFrame, column: str, max_bits: int = 1 << 26) -> np.ndarray:
    """Bits of the hashed ids, OR-ed on the executors; at most max_bits / 8 bytes reach the driver.

    False positives only let extra rows through to an exact join.
    """
    count = ids.count()
    bits = 1 << 16
    while bits < 24 * count and bits < max_bits:
        bits <<= 1
    words = (
        ids.select(F.pmod(F.xxhash64(F.lit(5), F.col(column)), F.lit(bits)).alias("s"))
        .select(F.shiftright("s", 6).alias("w"), F.expr("shiftleft(1L, cast(s & 63 as int))").alias("v"))
        .groupBy("w")
        .agg(F.bit_or("v").alias("v"))
        .toPandas()
    )
    out = np.zeros(bits // 64, np.int64)
    out[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64)
    return out.view(np.uint64)


# --- text as bytes -------------------------------------------------------------

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    key = str(int(base))
    if key not in _powers or len(_powers[key]) < n:
        size = 1 << max(16, int(n).bit_length())
        grown = np.full(size, base, np.uint64)
        grown[0] = 1
        _powers[key] = np.multiply.accumulate(grown)
    return _powers[key][:n]


def _places(n: int) -> np.ndarray:
    """A random-looking number for each place in a word."""
    if "places" not in _powers or len(_powers["places"]) < n:
        size = 1 << max(12, int(n).bit_length())
        _powers["places"] = mix(np.arange(1, size + 1, dtype=np.uint64) * BASE)
    return _powers["places"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Rolling:
    """Hashes of any slices of one unit array, each in constant time: a polynomial modulo 2 ** 64, for
    candidates only. Some unlike slices of over 1,000 units have equal hashes."""

    def __init__(self, units: np.ndarray):
        n = len(units)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((units.astype(np.uint64) + np.uint64(7)) * _power(BASE, n), out=self.sums[1:])
        self.back = _power(INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.back[start]
        return mix(raw ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


#: Bytes of ASCII white space: space and \x09-\x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A random-looking number for each byte, the same for A-Z and a-z.
_LETTERS = mix(_LOWER.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))


def utf8(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying texts into Python; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if buffers[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def space_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the white-space separated, A-Z lower-cased words of every text, and where each text's begin."""
    inside = ~_SPACE[data]
    n = len(data)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return _hashes_of(data, starts, ends), np.searchsorted(starts, offsets)


def _hashes_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of words in order, apart: the sum over their bytes of a number of the byte xor one of its place in
    the word. No polynomial, so no two words collide by their pattern."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] = 1
    inside[ends] -= 1
    letters = _LETTERS[data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]]
    letters ^= _places(int(size.max()))[place]
    return mix(np.add.reduceat(letters, np.cumsum(size) - size) ^ (size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def slices(offsets: np.ndarray, limit: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of texts of up to `limit` units together; a longer text comes alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi
