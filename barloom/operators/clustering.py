"""k-means, silhouette and t-SNE of a survivor set, and summaries of its clusters.

The sets are capped (140 rows), so the iterative fits run as one seeded task; summaries are
DataFrame operations, and the silhouette of any number of rows goes by pairs of chunks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rng as R
from ..functions import stats as S
from ..schema import FAMILIES, MOST_SURVIVORS
from .apart import packed, unpacked


def _square(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)


def kmeans(x: np.ndarray, k: int, seed: int = 7, rounds: int = 120) -> tuple[np.ndarray, np.ndarray]:
    """(labels, centroids): seeded k-means++ and Lloyd's rounds until no label moves; an empty cluster takes a drawn row."""
    n, draw = len(x), R.mulberry32(seed)
    k = min(k, n)
    some = lambda: x[math.floor(draw() * n)]
    centres = [some()]
    nearest = np.full(n, np.inf)
    while len(centres) < k:
        nearest = np.minimum(nearest, ((x - centres[-1]) ** 2).sum(axis=1))
        total = float(nearest.cumsum()[-1])
        if total == 0:
            centres.append(some())
            continue
        passed = np.flatnonzero(draw() * total - nearest.cumsum() <= 0)
        centres.append(x[passed[0] if len(passed) else n - 1])
    c, labels = np.array(centres), np.zeros(n, np.int64)
    for turn in range(rounds):
        new = _square(x, c).argmin(axis=1)
        moved, labels = bool((new != labels).any()), new
        c = np.array([x[labels == i].mean(axis=0) if (labels == i).any() else some() for i in range(k)])
        if not moved and turn:
            break
    return labels, c


def silhouette_of(x: np.ndarray, labels: np.ndarray) -> float:
    n, groups = len(x), np.unique(labels)
    if n < 3 or len(groups) < 2:
        return 0.0
    d = np.sqrt(_square(x, x))
    sums = np.stack([d[:, labels == g].sum(axis=1) for g in groups], axis=1)
    size = np.array([(labels == g).sum() for g in groups])
    own = np.searchsorted(groups, labels)
    a = sums[np.arange(n), own] / np.maximum(size[own] - 1, 1)
    other = sums / size
    other[np.arange(n), own] = np.inf
    b = other.min(axis=1)
    top = np.maximum(a, b)
    s = np.where((size[own] > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0.0)
    return float(s.sum() / n)


def auto_kmeans(x: np.ndarray, low: int, high: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The best k by silhouette, less for tiny clusters, a little more for more clusters."""
    upper = min(high, max(low, len(x) // 5))
    best, top = None, -math.inf
    for k in range(min(low, upper), upper + 1):
        labels, c = kmeans(x, k, seed + k)
        smallest = np.bincount(labels, minlength=len(c)).min() / len(x)
        score = silhouette_of(x, labels) - (0.35 if smallest < 0.04 else 0.12 if smallest < 0.08 else 0) + 0.03 * (k - min(low, upper))
        if score > top:
            best, top = (labels, c), score
    return best


def _affinities(d2: np.ndarray, perplexity: float) -> np.ndarray:
    """Rows of conditional probabilities whose bandwidth matches the perplexity, by bisection."""
    n, want = len(d2), math.log(perplexity)
    out = np.zeros((n, n))
    for i in range(n):
        d, beta, low, high = np.delete(d2[i], i), 1.0, 0.0, math.inf
        for _ in range(60):
            p = np.exp(-d * beta)
            total = max(p.sum(), 1e-12)
            gap = beta * float(d @ p) / total + math.log(total) - want
            if abs(gap) < 1e-5:
                break
            low, high = (beta, high) if gap > 0 else (low, beta)
            beta = beta * 2 if math.isinf(high) else (low + high) / 2
        p = np.exp(-d * beta)
        out[i] = np.insert(p / max(p.sum(), 1e-12), i, 0.0)
    return out


def tsne(x: np.ndarray, perplexity: float, rounds: int = 480, seed: int = 42, rate: float = 180.0) -> np.ndarray:
    """Exact t-SNE to two dimensions with early exaggeration, momentum and gains."""
    n = len(x)
    if n < 4:
        return np.array([[2.0 * i - n, 0.0] for i in range(n)]).reshape(n, 2)
    p = _affinities(_square(x, x), max(2, min(perplexity, (n - 1) // 3)))
    p = (p + p.T) / 2
    p /= max(p.sum(), 1e-300)
    draw = R.mulberry32(seed)
    y = np.array([R.gauss(draw) * 1e-2 for _ in range(2 * n)]).reshape(n, 2)
    speed, gain = np.zeros((n, 2)), np.ones((n, 2))
    for turn in range(rounds):
        diff = y[:, None, :] - y[None, :, :]
        q = 1 / (1 + (diff**2).sum(axis=2))
        np.fill_diagonal(q, 0)
        pull = ((12 if turn < 120 else 1) * p - q / max(q.sum(), 1e-12)) * q
        slope = 4 * (pull[:, :, None] * diff).sum(axis=1)
        gain = np.maximum(0.01, np.where(np.sign(slope) == np.sign(speed), gain * 0.8, gain + 0.2))
        speed = (0.5 if turn < 250 else 0.8) * speed - rate * gain * slope
        y = y + speed
        y -= y.mean(axis=0)
    return y


def _one_task(rows: DataFrame, work: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """The whole survivor set (genome_id, z) in one task, in order of genome_id; more rows than survivors may be are an error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.concat(list(parts), ignore_index=True)
        if len(held) > MOST_SURVIVORS:
            raise ValueError(f"{len(held)} rows; these fits are for {MOST_SURVIVORS} survivors at most")
        if len(held):
            held = held.sort_values("genome_id", ignore_index=True)
            yield pd.DataFrame({"genome_id": held["genome_id"], **work(np.stack(held["z"].to_numpy()))})

    return rows.select("genome_id", "z").coalesce(1).mapInPandas(run, "genome_id string, " + schema)


def kmeans_labels(rows: DataFrame, k: int | None, seed: int) -> DataFrame:
    """genome_id, cluster; k None chooses it from 2 to 8."""

    def work(x: np.ndarray) -> dict[str, np.ndarray]:
        labels, _ = kmeans(x, k, seed) if k else auto_kmeans(x, 2, min(8, max(2, len(x) // 8)), seed)
        return {"cluster": labels}

    return _one_task(rows, work, "cluster int")


def embedding(rows: DataFrame, seed: int, rounds: int = 480) -> DataFrame:
    """genome_id, x, y."""

    def work(x: np.ndarray) -> dict[str, np.ndarray]:
        y = tsne(x, max(5, min(30, len(x) // 4)), rounds, seed)
        return {"x": y[:, 0], "y": y[:, 1]}

    return _one_task(rows, work, "x double, y double")


# --- as DataFrame operations ---------------------------------------------------------


def _distance(a: str, b: str):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))


def nearest_centroid(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """genome_id, cluster, distance: the nearest of (cluster, c), ties to the lowest cluster. Centroids are few: one array,
    which each row looks through without a join."""
    every = centroids.agg(F.collect_list(F.struct("cluster", "c"))).scalar()
    near = F.array_min(F.transform("every", lambda x: F.struct(_distance("z", x["c"]).alias("distance"), x["cluster"].alias("cluster"))))
    return rows.withColumn("every", every).select("genome_id", near.alias("m")).select("genome_id", "m.cluster", "m.distance")


#: Rows of a tile of distances, the most bytes of a chunk's vectors and of a part's, and the most clusters of a chunk whose columns are summed along with its rows.
TILE, CHUNK_BYTES, PART_BYTES, FEW = 256, 8 << 20, 64 << 20, 64
#: Marks sums within a row's own cluster, and least means of others, among those of clusters that lie in several chunks; no mean is NONE.
OWN, NEXT, NONE = -1, -2, -1.0


def _least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The lower means of two; NONE is no mean, and NaN is above all others."""
    return np.where(a == NONE, b, np.where(b == NONE, a, np.fmin(a, b)))


def _pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """genome_id, key, dims, z: vectors as bytes."""
    for b in batches:
        z, dims = b.column("z"), b.column("z").value_lengths().to_numpy(zero_copy_only=False)
        for lo, hi in _runs(dims):
            x = z.slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(hi - lo, dims[lo])
            yield pa.RecordBatch.from_arrays([b.column("genome_id")[lo:hi], b.column("key")[lo:hi], pa.array(dims[lo:hi], pa.int32()), packed(x)], ["genome_id", "key", "dims", "z"])


def _runs(of: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of runs of equal neighbours."""
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(of)), bool), of[1:] != of[:-1]]))
    return list(zip(at.tolist(), [*at[1:].tolist(), len(of)]))


def _pack_chunk(rows: pa.Table) -> pa.Table:
    """One row of a chunk's rows (genome_id, key, dims, z, chunk, split, n), in order of cluster: its vectors, and where clusters end."""
    rows = rows.sort_by([("key", "ascending"), ("genome_id", "ascending")]).combine_chunks()
    dims = rows.column("dims")[0].as_py()
    if pc.any(pc.not_equal(rows.column("dims"), dims)).as_py():
        raise ValueError("vectors of several lengths")
    ends = [hi for _, hi in _runs(pc.rank(rows.column("key"), tiebreaker="dense").to_numpy())]
    x = unpacked(rows.column("z").combine_chunks(), dims)
    one = {"chunk": rows.column("chunk")[0].as_py(), "split": rows.column("split")[0].as_py(), "n": rows.column("n")[0].as_py(), "dims": dims, "ends": ends, "z": packed(x.reshape(1, -1))[0].as_py()}
    return pa.Table.from_pylist([one], _CHUNK)


#: A chunk: the first chunk of its cluster and the cluster's rows if that lies in several, else -1; vectors in order of cluster, and where clusters end.
_CHUNK = pa.schema([("chunk", pa.int32()), ("split", pa.int32()), ("n", pa.int64()), ("dims", pa.int32()), ("ends", pa.list_(pa.int32())), ("z", pa.binary())])
_SUMS = pa.schema([("chunk", pa.int32()), ("split", pa.int32()), ("n", pa.int64()), ("ends", pa.list_(pa.int32())), ("what", pa.int32()), ("count", pa.int64()), ("v", pa.binary())])


class _Chunk:
    def __init__(self, b: pa.RecordBatch, k: int, prefix: str = ""):
        of = lambda c: b.column(prefix + c)[k]
        self.at, self.split, self.n, dims, self.ends = (of(c).as_py() for c in ("chunk", "split", "n", "dims", "ends"))
        raw = of("z").as_buffer()
        x = np.frombuffer(raw, "<f8" if len(raw) == 8 * dims * self.ends[-1] and dims else "<f4").astype(np.float64).reshape(self.ends[-1], dims)
        self.starts = np.array([0, *self.ends[:-1]])
        self.size = np.diff([0, *self.ends])
        self.kind = np.repeat(np.arange(len(self.ends)), self.size)
        self.x, self.xx = x, (x * x).sum(axis=1)
        self.rows = np.concatenate([x, self.xx[:, None], np.ones((len(x), 1))], axis=1)
        self.columns = np.ascontiguousarray(np.concatenate([-2 * x, np.ones((len(x), 1)), self.xx[:, None]], axis=1).T)


def _distances(a: _Chunk, b: _Chunk) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, distances of rows of a to those of b), by tiles."""
    if a.x.shape[1] != b.x.shape[1]:
        raise ValueError("vectors of several lengths")
    top = b.xx.max()
    for lo in range(0, len(a.x), TILE):
        d = a.rows[lo : lo + TILE] @ b.columns
        for r in np.flatnonzero(d.min(axis=1) < 1e-6 * (a.xx[lo : lo + TILE] + top)):
            j = np.flatnonzero(d[r] < 1e-6 * (a.xx[lo + r] + b.xx))  # near copies lose digits
            for k in range(0, len(j), 1 << 14):
                d[r, j[k : k + (1 << 14)]] = ((a.x[lo + r] - b.x[j[k : k + (1 << 14)]]) ** 2).sum(axis=1)
        if a.at == b.at:
            here = np.arange(len(d))
            d[here, lo + here] = 0
        yield lo, np.sqrt(d, out=d)


class _Totals:
    """What a task adds up for each chunk: by cluster in several chunks, OWN or NEXT a number for each of its rows."""

    def __init__(self):
        self.held: dict[tuple[int, int], list] = {}

    def meet(self, a: _Chunk, b: _Chunk) -> None:
        """The pairs of two chunks, or of one with itself, both ways. One pass does if the columns are those of few clusters."""
        if a.at != b.at and len(a.ends) > FEW:
            if len(b.ends) > FEW:
                self._pass(a, b, False)
                self._pass(b, a, False)
                return
            a, b = b, a
        self._pass(a, b, a.at != b.at)

    def _pass(self, a: _Chunk, b: _Chunk, both: bool) -> None:
        there, back, one = np.empty((len(a.x), len(b.ends) if len(b.ends) <= FEW else 0)), np.zeros((len(b.x), len(a.ends) if both else 0)), np.ones(len(b.x))
        for lo, d in _distances(a, b):
            for first, end in _runs(a.kind[lo : lo + len(d)]) if both else ():
                back[:, a.kind[lo + first]] += np.ones(end - first) @ d[first:end]
            sums = (d @ one)[:, None] if len(b.ends) == 1 else np.add.reduceat(d, b.starts, axis=1)
            if there.shape[1]:
                there[lo : lo + len(d)] = sums
            else:
                self._add(a, b, lo, sums)
        if there.shape[1]:
            self._add(a, b, 0, there)
        if both:
            self._add(b, a, 0, back)

    def _add(self, a: _Chunk, b: _Chunk, lo: int, sums: np.ndarray) -> None:
        """Sums of distances of a's rows from lo on to each cluster of b."""
        hi, others = lo + len(sums), len(b.ends)
        if b.split >= 0:
            self._of(a, b.split, b.n)[lo:hi] += sums[:, 0]
            return
        if a.at == b.at:
            here, own = np.arange(len(sums)), a.kind[lo:hi]
            self._of(a, OWN)[lo:hi] += sums[here, own]
            sums[here, own], others = np.nan, others - 1
        if others:
            v = self._of(a, NEXT)
            v[lo:hi] = _least(v[lo:hi], np.fmin.reduce(sums / b.size, axis=1))

    def _of(self, a: _Chunk, what: int, n: int = 0) -> np.ndarray:
        if (a.at, what) not in self.held:
            self.held[a.at, what] = [a.split, a.n, a.ends, n, np.full(len(a.x), NONE if what == NEXT else 0.0)]
        return self.held[a.at, what][-1]

    def batches(self) -> Iterator[pa.RecordBatch]:
        for (chunk, what), (split, n, ends, count, v) in self.held.items():
            yield pa.RecordBatch.from_pylist([{"chunk": chunk, "split": split, "n": n, "ends": ends, "what": what, "count": count, "v": v.tobytes()}], _SUMS)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals, left = _Totals(), None
    for batch in batches:
        for k in range(len(batch)):
            if left is None or left.at != batch.column("chunk")[k].as_py():
                left = _Chunk(batch, k)
            totals.meet(left, _Chunk(batch, k, "r_") if left.at != batch.column("r_chunk")[k].as_py() else left)
    yield from totals.batches()


def _scores(rows: pd.DataFrame) -> pd.DataFrame:
    """The sum of the scores of a chunk's rows."""
    split, n, ends = rows["split"].iloc[0], rows["n"].iloc[0], np.asarray(rows["ends"].iloc[0])
    size = np.diff(ends, prepend=0)
    size = np.full(ends[-1], n) if split >= 0 else np.repeat(size, size)
    own, after, sums = np.zeros(ends[-1]), np.full(ends[-1], NONE), {}
    for what, count, v in zip(rows["what"], rows["count"], rows["v"]):
        v = np.frombuffer(v)
        if what == NEXT:
            after = _least(after, v)
        elif what in (OWN, split):
            own = own + v
        else:
            sums[what, count] = sums.get((what, count), 0.0) + v
    for (_, count), v in sorted(sums.items(), key=lambda x: x[0]):
        after = _least(after, v / count)
    a = own / np.maximum(size - 1, 1)
    top = np.maximum(a, after)
    s = np.where((size > 1) & (after != NONE) & (top != 0), (after - a) / np.where(top != 0, top, 1), 0.0)
    return pd.DataFrame({"total": [s.sum()]})


def silhouette(rows: DataFrame, block: int = 4096) -> DataFrame:
    """One row: silhouette of (genome_id, z, cluster), genome_id unique; singletons count 0, as do rows without a cluster or a vector.

    Exact, over all pairs, each of which is worked out once. Rows are put into chunks of about `block`: a large cluster or pieces of it, by a hash, or several
    small ones. Chunks are dealt into parts, and a task reads two of them and returns sums by row and cluster, so no row is copied for every chunk that it
    meets. What is written grows with the rows and the number of parts, the work with the square of the rows; a task's memory is that of two parts."""
    spark = rows.sparkSession
    whole = rows.select("genome_id", F.col("z").cast("array<double>").alias("z"), F.col("cluster").cast("string").alias("key"))
    count, dims = whole.agg(F.count("*"), F.max(F.size("z"))).first()
    block = max(1, min(block, CHUNK_BYTES // (8 * max(1, dims or 0))))
    some = whole.where("z is not null and key is not null")
    large = F.when(F.col("n") > block // 8, F.col("key"))
    sizes = {r["key"]: r["n"] for r in some.groupBy("key").agg(F.count("*").alias("n")).groupBy(large.alias("key")).agg(F.sum("n").alias("n")).collect()}
    bins = chunks = math.ceil(sizes.pop(None, 0) / block)
    split = []  # key, rows, first chunk, chunks
    for key, n in sorted(sizes.items()):  # some 8 * count / block clusters at most
        split.append((key, n, chunks, math.ceil(n / block)))
        chunks += split[-1][-1]
    split = F.broadcast(spark.createDataFrame(split, "key string, n long, split int, pieces int"))
    parts = max(1, min(chunks, max(math.ceil(math.sqrt(6 * spark.sparkContext.defaultParallelism)), math.ceil(8 * count * max(1, dims or 0) / PART_BYTES))))
    piece = F.when(F.col("split").isNotNull(), F.col("split") + F.pmod(F.xxhash64("genome_id"), F.col("pieces"))).otherwise(F.pmod(F.xxhash64("key"), F.lit(max(1, bins))))
    small = some.mapInArrow(_pack_rows, "genome_id string, key string, dims int, z binary").join(split, "key", "left")
    dealt = small.select("genome_id", "key", "dims", "z", piece.cast("int").alias("chunk"), F.when(F.col("pieces") > 1, F.col("split")).otherwise(-1).alias("split"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    packs = dealt.groupBy("chunk").applyInArrow(_pack_chunk, "chunk int, split int, n long, dims int, ends array<int>, z binary")
    left = packs.repartitionById(parts, F.floor(F.col("chunk").cast("long") * parts / max(1, chunks)).cast("int"))
    right = left.select(*(F.col(c).alias(f"r_{c}") for c in left.columns))
    even = (F.col("chunk") + F.col("r_chunk")) % 2 == 0
    once = (F.col("chunk") == F.col("r_chunk")) | ((F.col("chunk") < F.col("r_chunk")) & even) | ((F.col("chunk") > F.col("r_chunk")) & ~even)
    pairs = left.join(right.hint("shuffle_replicate_nl"), once)
    sums = pairs.mapInArrow(_sums, "chunk int, split int, n long, ends array<int>, what int, count long, v binary")
    scores = sums.groupBy("chunk").applyInPandas(_scores, "total double")
    return scores.agg(F.try_divide(F.coalesce(F.sum("total"), F.lit(0.0)), F.lit(float(count))).alias("silhouette"))


def summary(rows: DataFrame) -> DataFrame:
    """cluster, size, means of four metrics, family_mix, label, medoid_id of rows
    (genome_id, cluster, z, family, sharpe, cagr, max_drawdown, vol, avg_hold, bench_corr)."""
    dims = rows.select("cluster", F.posexplode("z").alias("k", "v")).groupBy("cluster", "k").agg(F.avg("v").alias("v"))
    centre = dims.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("c"))
    medoid = rows.join(centre, "cluster").groupBy("cluster").agg(F.min(F.struct(_distance("z", "c").alias("d"), F.col("genome_id").alias("g"))).alias("m"))
    mix = rows.groupBy("cluster", "family").agg(F.count("*").alias("n"))
    by = Window.partitionBy("cluster").orderBy(F.desc("n"), "family")
    lead = mix.withColumn("k", F.row_number().over(by)).groupBy("cluster").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("family", "n")))).alias("family_mix"),
        F.max(F.when(F.col("k") == 1, F.col("family"))).alias("lead"), F.max(F.when(F.col("k") == 1, F.col("n"))).alias("lead_n"),
    )
    means = rows.groupBy("cluster").agg(
        F.count("*").alias("size"), *(F.avg(c).alias(c) for c in ("sharpe", "cagr", "max_drawdown", "vol")), F.avg("avg_hold").alias("hold"),
        F.avg(F.abs("max_drawdown")).alias("depth"), F.abs(F.avg("bench_corr")).alias("corr"),
    )
    label = F.create_map(*(x for f, (text, _) in FAMILIES.items() for x in (F.lit(f), F.lit(text))))
    family = F.coalesce(F.element_at(label, F.col("lead")), F.lit("Mixed"))
    who = F.when(F.col("lead_n") / F.col("size") > 0.7, family).otherwise(F.concat(family, F.lit("-led mix")))
    tempo = F.when(F.col("hold") > 40, "slow").when(F.col("hold") > 12, "swing").otherwise("fast")
    risk = F.when(F.col("depth") > 0.3, "high risk").when(F.col("depth") > 0.15, "moderate").otherwise("contained")
    named = means.join(lead, "cluster").join(medoid, "cluster").withColumn("base", F.concat_ws(" · ", who, tempo, risk))
    link = F.when(F.col("corr") > 0.45, "market-linked").when(F.col("corr") < 0.2, "market-neutral").otherwise("partly linked")
    edge = F.when(F.col("sharpe") > 0.15, "positive edge").when(F.col("sharpe") < -0.15, "negative edge").otherwise("flat")
    shared = F.count("*").over(Window.partitionBy("base")) > 1
    return named.select(
        "cluster", "size", F.when(shared, F.concat_ws(" · ", "base", link, edge)).otherwise(F.col("base")).alias("label"),
        "sharpe", "cagr", "max_drawdown", "vol", "family_mix", F.col("m.g").alias("medoid_id"),
    )


def blobs(points: DataFrame) -> DataFrame:
    """cluster, x, y, radius of chart points (cluster, x, y): 1.5 times their spread, in 34..240."""
    spread = F.sqrt(F.var_pop("x") + F.var_pop("y"))
    return points.groupBy("cluster").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), S.clamp(1.5 * spread, 34.0, 240.0).alias("radius"))
