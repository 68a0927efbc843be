"""Line deduplication by a segment-partition edit join.

Two lines within edit distance `edits` agree, for one of the edits + 1 even segments of
the shorter line, in that segment at a position of the longer line shifted by at most
`edits`. Every line is therefore posted under its own segments and, for each length up
to `edits` shorter than its own, under the substrings that could be a segment of a line
of that length; positions follow the multi-match-aware bounds. All of these are slices
of one rolling hash, so a posting costs a few machine operations.

Pre-aggregation: each map task links the lines of equal posting it holds to one of them and
sends that on, so a posting shared by a third of all lines is at most one row a task. This
tells which lines meet another one at all. Only their texts are read again and posted in
full; the lines of each posting are verified against each other, in blocks of bounded size, by a
banded bit-parallel edit distance, and only verified links are closed into classes.

Lines are told apart by 128 bits of BLAKE2b; postings, by a rolling hash of 64 bits, only propose.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import BLOCK, Members, Rolling, Tables, components, distinct_groups, group_links, mix, partitions, prepare, released, slices, table

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance of a and b is at most `edits`.

    The common ends are dropped; on the rest runs the bit-parallel recurrence of Myers in
    Hyyrö's banded form: one word of 2 * edits + 1 bits slides along the diagonal.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > edits:
        return False
    lo, n = 0, len(b)
    step = n
    while step:  # common prefix by doubling comparisons of slices
        if a[lo : lo + step] == b[lo : lo + step]:
            lo += step
            step = min(step, n - lo)
        else:
            step //= 2
    a, b = a[lo:], b[lo:]
    hi, n = 0, len(b)
    step = n
    while step:
        if b[n - hi - step : n - hi] == a[len(a) - hi - step : len(a) - hi]:
            hi += step
            step = min(step, n - hi)
        else:
            step //= 2
    a, b = a[: len(a) - hi], b[: n - hi]
    m, n = len(a), len(b)
    if not m or not n:
        return max(m, n) <= edits
    edits = min(edits, m)
    # Rows are characters of b; bit k of the band at row j stands for a's character j - edits + k.
    width = 2 * edits + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    vp, vn = full << edits & full, 0
    where: dict[str, int] = {}
    for i, c in enumerate(a[:edits]):
        where[c] = where.get(c, 0) | 1 << i
    score = edits  # of the band's last cell, at a's character j + edits
    for j in range(n):
        i = j + edits  # a's character that enters the band
        if i < m:
            where[a[i]] = where.get(a[i], 0) | 1 << i
        pm = where.get(b[j], 0)
        pm = (pm >> (j - edits) if j >= edits else pm << (edits - j)) & full
        d0 = ((((pm & vp) + vp) ^ vp) | pm | vn) & full
        hp = vn | ~(d0 | vp) & full
        hn = d0 & vp
        if i < m:
            score += 0 if d0 & top else 1
        else:  # past a's end: follow its last character, which climbs in the band
            bit = 1 << (m - 1 - j + edits)
            score += 1 if hp & bit else -1 if hn & bit else 0
        shifted = d0 >> 1
        vp = (hn | ~(shifted | hp)) & full
        vn = shifted & hp
        if score > 2 * edits + n - m:  # the steps past a's end cannot make up for it
            return False
    return score <= edits


def split_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of every line of code-point arrays joined end to end; lines end at a line feed."""
    feeds = np.flatnonzero(data == 10)
    ends = np.sort(np.concatenate([feeds, offsets[1:]]))
    n_lines = np.diff(np.searchsorted(feeds, offsets)) + 1
    of = np.repeat(np.arange(len(offsets) - 1), n_lines)
    at = np.cumsum(n_lines) - n_lines
    starts = np.empty(len(ends), np.int64)
    starts[1:] = ends[:-1] + 1
    starts[at] = offsets[:-1]
    # a text that ends in a line feed has an empty last line at its end; sorting keeps the feed before it
    return starts, ends, of


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = "".join(texts).encode("utf-32-le", "surrogatepass")
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer(raw, np.uint32), offsets


def allowed(size: np.ndarray, edits: int, min_chars: int) -> np.ndarray:
    """Edits between a line and longer ones: `edits` from min_chars characters on, in proportion below."""
    return np.minimum(edits, size * edits // max(1, min_chars))


def postings(
    rolling: Rolling, start: np.ndarray, size: np.ndarray, edits: int, owners: tuple[int, int] | None = None
) -> list[np.ndarray]:
    """Keys of all lines: own segments, and substrings that may be segments of shorter lines.
    Only lengths in [low, high) of `owners` own segments, if it is given."""
    out = []
    parts = edits + 1
    for less in range(edits + 1):
        other = size - less  # length of the line that may own the segment
        base, longer = other // parts, other % parts
        for k in range(parts):
            # the last `longer` segments have one character more
            width = base + (k >= parts - longer)
            at = k * base + np.maximum(0, k - (parts - longer))
            low = np.maximum(-k, less - (edits - k))
            high = np.minimum(k, less + (edits - k))
            for shift in range(-edits, edits + 1):
                if not low <= shift <= high:
                    continue
                ok = (at + shift >= 0) & (at + shift + width <= size) & (other > 0)
                if owners:
                    ok &= (other >= owners[0]) & (other < owners[1])
                begin = start + np.where(ok, at + shift, 0)
                key = rolling.of(begin, begin + np.where(ok, width, 0))
                key = mix(key ^ (other.astype(np.uint64) * np.uint64(2 * parts) + np.uint64(2 * k + 1)) * _GOLD)
                out.append(np.where(ok, key, 0).view(np.int64))
    return out


def _all_postings(rolling: Rolling, start: np.ndarray, size: np.ndarray, edits: int, min_chars: int, short: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, keys) by the edits of the lengths that own segments; lengths that allow none need no posting."""
    if not short:
        for key in postings(rolling, start, size, edits):
            yield np.arange(len(size)), key
        return
    for e in range(1, edits + 1):
        low = -(-e * max(1, min_chars) // edits)
        high = 1 << 62 if e == edits else -(-(e + 1) * max(1, min_chars) // edits)
        rows = np.flatnonzero((size >= low) & (size < high + e))
        if len(rows):
            for key in postings(rolling, start[rows], size[rows], e, (low, high)):
                yield rows, key


def _line_ids(texts: list[str], of: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """(two bigints for each line, its content); lines by text and number of the line in it, in order."""
    cut, at, out, found = [], -1, bytearray(), []
    for i, k in zip(of.tolist(), number.tolist()):
        if i != at:
            cut, at = texts[i].split("\n"), i
        found.append(cut[k])
        out += blake2b(cut[k].encode(), digest_size=16).digest()
    return np.frombuffer(bytes(out), np.int64).reshape(-1, 2), found


#: White space by code point; none lies beyond.
_BLANK = np.array([chr(c).isspace() for c in range(0x3001)] + [False])


def _cut(texts: list[str | None], min_chars: int, short: bool = False) -> Iterator[tuple[int, Rolling, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """(first text, code points, start, end, text, line number, id, content) of the lines that count, slice by slice:
    those of min_chars characters or more, and if `short` all shorter ones that are not blank."""
    filled = [t or "" for t in texts]
    sizes = np.zeros(len(filled) + 1, np.int64)
    np.cumsum([len(t) for t in filled], out=sizes[1:])
    for lo, hi in slices(sizes, 1 << 21):
        points, offsets = code_points(filled[lo:hi])
        start, end, of = split_lines(points, offsets)
        number = np.arange(len(of)) - np.searchsorted(of, of)
        keep = end - start >= min_chars
        if short:
            inked = np.zeros(len(points) + 1, np.int32)
            np.cumsum(~_BLANK[np.minimum(points, len(_BLANK) - 1)], out=inked[1:])
            keep |= inked[end] > inked[start]
        ids, content = _line_ids(filled[lo:hi], of[keep], number[keep])
        yield lo, points, start[keep], end[keep], of[keep], number[keep], ids, content


def _occurrences(min_chars: int, short: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [batch.column(k) for k in range(batch.num_columns) if batch.schema.names[k] != "text"]
            names = [x for x in batch.schema.names if x != "text"]
            for lo, _, _, _, of, number, ids, _ in _cut(batch.column("text").to_pylist(), min_chars, short):
                at = pa.array(of + lo)
                yield pa.RecordBatch.from_arrays(
                    [*(r.take(at) for r in rows), pa.array(number), pa.array(ids[:, 0].copy()), pa.array(ids[:, 1].copy())], [*names, "line_no", "line", "check"]
                )

    return run


def _post(min_chars: int, edits: int, short: bool, held_rows: int = 1 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        lines: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            key, line = np.concatenate(keys), np.concatenate(lines)
            order = np.lexsort((line, key))
            key, line = key[order], line[order]
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            hub = line[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
            local = ~first & (line != hub)
            # a posting to send on has its own key; a line that met another here has key 0
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([key[first], np.zeros(2 * local.sum(), np.int64)])),
                    pa.array(np.concatenate([hub[first], line[local], hub[local]])),
                ],
                ["key", "line"],
            )

        for batch in batches:
            for _, points, start, end, _, _, ids, _ in _cut(batch.column("text").to_pylist(), min_chars, short):
                line, one = np.unique(ids[:, 0], return_index=True)
                start, size = start[one], (end - start)[one]
                for rows, key in _all_postings(Rolling(points), start, size, edits, min_chars, short):
                    live = key != 0
                    keys.append(key[live])
                    lines.append(line[rows[live]])
                    held += int(live.sum())
            if held >= held_rows:
                yield flush()
                keys.clear()
                lines.clear()
                held = 0
        if held:
            yield flush()

    return run


def _meet(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The lines that share a posting with another one, in a partition sorted by posting; those of key 0 are known to."""
    last_key = last_line = None
    held: list[pa.RecordBatch] = []

    def found() -> np.ndarray:
        nonlocal last_key, last_line
        key, line = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("key", "line"))
        held.clear()
        known = line[key == 0]
        key, line = key[key != 0], line[key != 0]
        if not len(key):
            return np.unique(known)
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        first[0] = key[0] != last_key
        at = np.maximum.accumulate(np.where(first, np.arange(len(key)), -1))
        hub = np.where(at >= 0, line[np.maximum(at, 0)], line[0] if last_line is None else last_line)
        met = line != hub
        last_key, last_line = key[-1], hub[-1]
        return np.unique(np.concatenate([known, line[met], hub[met]]))

    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.RecordBatch.from_arrays([pa.array(found())], ["line"])
            n = 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(found())], ["line"])


def _texts_of(min_chars: int, short: bool, bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bits.value
        n_bits = np.uint64(len(words) * 64)
        for batch in batches:
            for _, _, _, _, _, _, ids, content in _cut(batch.column("text").to_pylist(), min_chars, short):
                line = ids[:, 0]
                spot = (mix(line.view(np.uint64)) % n_bits).astype(np.int64)
                hit = ((words[spot >> 6] >> (spot & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
                if not hit.any():
                    continue
                _, one = np.unique(ids[hit], axis=0, return_index=True)
                rows = np.flatnonzero(hit)[one]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(line[rows]), pa.array(ids[rows, 1]), pa.array([content[r] for r in rows.tolist()], pa.string())], ["line", "check", "content"]
                )

    return run


def _keys_of(min_chars: int, edits: int, short: bool):
    """Every posting of some lines (node, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, node = batch.column("content").to_pylist(), batch.column("node").to_numpy()
            points, offsets = code_points(texts)
            for rows, key in _all_postings(Rolling(points), offsets[:-1], np.diff(offsets), edits, min_chars, short):
                live = key != 0
                if live.any():
                    yield pa.RecordBatch.from_arrays([pa.array(key[live]), pa.array(node[rows[live]])], ["group", "node"])

    return run


def _letters(texts: list[str]) -> np.ndarray:
    """How often each text has the characters of each of 32 kinds; one edit changes two of the counts by one at most."""
    points, offsets = code_points(texts)
    of = np.repeat(np.arange(len(texts)), np.diff(offsets))
    kind = (points * np.uint32(0x9E3779B1)) >> np.uint32(27)
    return np.bincount(of * 32 + kind, minlength=32 * len(texts)).reshape(-1, 32)


def _confirm(edits: int, min_chars: int, short: bool):
    def work(rows: pa.Table) -> pa.Table | None:
        """Links of the task's lines that are within the edits allowed to the shorter one."""
        members = Members(rows)
        if members.trees.count == 1:
            return None
        texts = rows.column("content").to_pylist()
        size = np.array([len(t) for t in texts])
        letters = _letters(texts)
        order = np.argsort(size, kind="stable")
        ranked = size[order]
        most = allowed(size, edits, min_chars) if short else np.full(len(texts), edits)
        for at in range(len(texts)):
            if members.trees.count == 1:
                break
            x = int(order[at])
            # lines within the edits of x; the shorter one of a pair says how many these are, so each pair is seen from it
            others = order[at + 1 : np.searchsorted(ranked, ranked[at] + most[x], side="right")]
            others = others[members.pairs(x, others)]
            near = np.abs(letters[others] - letters[x]).sum(axis=1) <= 2 * most[x]
            for y in others[near].tolist():
                if members.trees.of[x] != members.trees.of[y] and within(texts[x], texts[y], int(most[x])):
                    members.trees.join(x, y)
        return members.done()

    return work


def line_classes(docs: DataFrame, tables: Tables, edits: int = 2, min_chars: int = 40, block: int = BLOCK, short: bool = False) -> DataFrame:
    """line, check, class: the lines that are within `edits` of another one, over chains of such links."""
    spark = docs.sparkSession
    texts = docs.select("text")
    posted = texts.mapInArrow(released(_post(min_chars, edits, short)), "key long, line long")
    # lines that have met on the way have no key: deal them out by their own number
    dealt = posted.repartition(partitions(spark), F.when(F.col("key") == 0, F.col("line")).otherwise(F.col("key"))).sortWithinPartitions("key")
    meeting = tables.write(dealt.mapInArrow(released(_meet), "line long").distinct(), "meeting")
    bits = spark.sparkContext.broadcast(bloom_of_numbers(meeting, "line"))
    content = (
        texts.mapInArrow(released(_texts_of(min_chars, short, bits)), "line long, check long, content string")
        .join(meeting, "line", "left_semi")
        .groupBy("line", "check")
        .agg(F.min("content").alias("content"))
    )
    # numbers of their own: lines that agree in 64 bits only stay apart
    nodes = tables.write(content.withColumn("node", F.monotonically_increasing_id()), "meeting-lines")
    keys = tables.write(nodes.select("node", "content").mapInArrow(released(_keys_of(min_chars, edits, short)), "group long, node long").distinct(), "keys")
    members = distinct_groups(keys, "node").join(nodes.select("node", "content"), "node").select("group", "node", "content")
    members = tables.write(members, "members")
    near = group_links(members, _confirm(edits, min_chars, short), ["content"], tables, block)
    settled = components(near, tables).withColumnRenamed("id", "node")
    return tables.write(nodes.join(settled, "node").select("line", "check", F.col("comp").alias("class")), "classes")


def bloom_of_numbers(ids: DataFrame, column: str, max_bits: int = 1 << 26) -> np.ndarray:
    """As bloom_of, for ids that Python hashes itself: the spot is their splitmix64 finaliser."""
    count = ids.count()
    bits = 1 << 16
    while bits < 24 * count and bits < max_bits:
        bits <<= 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spot = (mix(batch.column(0).to_numpy().view(np.uint64)) % np.uint64(bits)).astype(np.int64)
            word = spot >> 6
            order = np.argsort(word)
            word, bit = word[order], np.uint64(1) << (spot[order] & 63).astype(np.uint64)
            at = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            yield pa.RecordBatch.from_arrays([pa.array(word[at]), pa.array(np.bitwise_or.reduceat(bit, at).view(np.int64))], ["w", "v"])

    words = ids.select(column).where(F.col(column).isNotNull()).mapInArrow(released(run), "w long, v long").groupBy("w").agg(F.bit_or("v").alias("v")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64)
    return out.view(np.uint64)


def _repeats(docs: DataFrame, edits: int, min_chars: int, block: int, short: bool, tables: Tables) -> DataFrame:
    """doc_id, row, line_no, class, first_doc, first_line; row: a hash of the text, so that rows of one doc_id are told apart."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    classes = line_classes(rows, tables, edits, min_chars, block, short)
    seen = tables.write(rows.mapInArrow(released(_occurrences(min_chars, short)), "doc_id long, row long, line_no long, line long, check long"), "lines")
    line = ["line", "check"]
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc"), F.col("row").alias("row"), F.col("line_no").alias("no"))
    by_line = seen.groupBy(*line).agg(F.min(order).alias("first"), F.max(order).alias("last"))
    # classes of one line are done; only lines in a class of several need the class's first
    near = by_line.join(classes, line)
    first = near.groupBy("class").agg(F.min("first").alias("top"))
    known = near.join(first, "class").select(*line, "class", "top").union(
        by_line.join(classes, line, "left_anti").where("first < last").select(*line, F.lit(None).cast("long").alias("class"), F.col("first").alias("top"))
    )
    return (
        seen.join(known, line)
        .where(~(F.col("doc_id").eqNullSafe(F.col("top.doc")) & (F.col("row") == F.col("top.row")) & (F.col("line_no") == F.col("top.no"))))
        .select("doc_id", "row", "line_no", F.coalesce("class", "line").alias("class"), F.col("top.doc").alias("first_doc"), F.col("top.no").alias("first_line"))
        .distinct()
    )


def repeated_lines(docs: DataFrame, edits: int = 2, min_chars: int = 40, block: int = BLOCK, short: bool = False) -> DataFrame:
    """doc_id, line_no, class, first_doc, first_line of every line that is not the first of its class.

    A class holds equal lines and lines linked by edit distance of at most `edits`, over
    chains. Its first line has the smallest (doc_id, line_no). Lines, between line feeds,
    of under `min_chars` characters are left alone, or, if `short`, compared with edits in
    proportion to the length of the shorter one (none is left of very short lines, of which
    exact copies count) unless they are blank. class is a number that a class's lines share. Null text
    has no lines. A null doc_id comes after all others. Rows equal in doc_id and text are one document, so a
    line there is repeated only if another line_no or document has it; rows of one doc_id
    with unlike texts are documents of their own, in order of a hash of the text.
    """
    with Tables(docs.sparkSession) as tables:
        found = _repeats(docs, edits, min_chars, block, short, tables)
        return table(found.select("doc_id", "line_no", "class", "first_doc", "first_line").distinct(), "repeated-lines")


@F.pandas_udf(StringType())
def _rest(text: pd.Series, gone: pd.Series) -> pd.Series:
    """The texts without the lines of these numbers."""

    def one(t: str | None, lines) -> str | None:
        if t is None:
            return None
        out = set(lines.tolist())
        return "\n".join(x for k, x in enumerate(t.split("\n")) if k not in out)

    return pd.Series([one(t, g) for t, g in zip(text, gone)], dtype=object)


def without_repeats(docs: DataFrame, edits: int = 2, min_chars: int = 40, short: bool = False) -> DataFrame:
    """docs without the lines that repeated_lines finds; all columns stay, n_chars is counted anew if there.

    A document that loses lines and has nothing but white space left goes. Rows without a
    doc_id or a text stay as they are; of rows that share a doc_id each loses its own lines.
    """
    named = docs.where("doc_id is not null")
    with Tables(docs.sparkSession) as tables:
        found = _repeats(named, edits, min_chars, BLOCK, short, tables)
        drops = table(found.groupBy("doc_id", "row").agg(F.collect_set("line_no").alias("gone")), "drops")
    # the rows travel as one column, so that none of theirs can be taken for the join's
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")
    rows = named.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), whole)
    joined = rows.join(drops, ["doc_id", "row"], "left")
    old = F.col("whole").getField("text")
    new = joined.withColumn("rest", _rest(F.when(F.col("gone").isNotNull(), old), F.col("gone"))).where("rest is null or rest rlike '[^\\\\s]'")
    kinds = dict(docs.dtypes)
    fresh = {"text": F.coalesce("rest", old)}
    if "n_chars" in kinds:
        fresh["n_chars"] = F.when(F.col("rest").isNull(), F.col("whole").getField("n_chars")).otherwise(F.length("rest")).cast(kinds["n_chars"])
    out = new.select(*(fresh.get(c, F.col("whole").getField(c)).alias(c) for c in docs.columns))
    return out.union(docs.where("doc_id is null"))
