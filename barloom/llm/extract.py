"""Main text of web pages: markup names the article, the host's suffix arrays find repeated boilerplate.

A page is read into blocks of text, each in a zone. Markup names what is never main text (scripts, menus, headers,
footers, sidebars, forms, and classes of notices, adverts and comments) and the article or main element. What it leaves
open is decided by the other pages of the host: the words outside articles are the page's token stream, streams of a host
are concatenated into suffix arrays, and a run of RUN words or more that begins in two different streams is boilerplate.

A host of any size is dealt to shards of some SHARD_WORDS words, each a suffix array of its own. A shard emits every class
of suffixes that share their first RUN words once, with the smallest and largest stream that holds it; two that differ,
in a shard or when those of all shards are put together by partial minima and maxima, make the class a repeated one. A word
is covered if one of its RUN-word runs is repeated: the same words that the longest repeated substrings cover, as these
consist of such runs.

The main text: the article elements' blocks if there are any; else those of the main element; else, of the blocks in
containers of content, if these hold half of the words, or of all, those that are covered by less than half. Text inside an article or main element is
never taken for boilerplate, whatever repeats it: copies and quotations are content. A page that is covered nearly whole
(COPY) is a copy of another, not boilerplate, and keeps its blocks.

Defined results: null html is empty; a null url, or one without `://`, belongs to the empty host; equal streams count as one page;
a page of only boilerplate has the empty text; repeated rows of a page are answered each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tables, mix, prepare

#: Words of the shortest run that counts as repeated.
RUN = 6
#: Words of a suffix array; one page may be longer.
SHARD_WORDS = 1 << 14
#: Covered share of its words from which a page is a copy.
COPY = 0.9
#: Repeated classes that are broadcast, 8 bytes each; more are joined by page, with the same result.
MOST_CLASSES = 1 << 20

# --- fixed values: elements and class words ------------------------------------------------

#: Elements whose content is no markup.
RAW = "script style textarea title xmp iframe noembed noframes".split()
#: Elements whose content isn't shown, or is no text of the page.
HIDDEN = set("head script style textarea title xmp iframe noembed noframes template noscript svg math canvas object audio video select datalist button".split())
#: Elements that are never main text.
CHROME = set("nav header footer aside form menu dialog".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block.
BLOCKS = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header"
    " hgroup hr html legend li main menu nav ol option optgroup p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that are looked for when their end tag comes.
CONTAINERS = HIDDEN | CHROME | set("article body blockquote center details div dl fieldset figure html main ol section summary table ul".split())
#: Words of class, id and role that name what is no main text.
HINTS = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo complementary cookie cookies copyright disqus"
    " footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion recommended related"
    " replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Of these, words that may name a part of the article where it is one.
OF_ARTICLE = {"header", "banner", "masthead"}
#: With these, a hint says what else the page has: "has-sidebar".
OF_LAYOUT = {"has", "with", "no", "without"}
#: Words of class and id that name a container of content.
CONTENT = set("article content entry main post story".split())

# --- pages into blocks ----------------------------------------------------------------------

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{'|'.join(RAW)})(?=[\s/>])(?P<rawattrs>[^>]*)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*+)>"
    r"|<[!?/a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[a-z]+")
#: Zones by rank: named as no main text, open, in a container of content, in the main element, in an article.
GONE, OPEN, HELD, MAIN, ARTICLE = range(5)
#: Of what leaves a hidden element, besides MAIN, which an article does, too: main elements alone, and nothing.
ONLY_MAIN, NEVER = 8, 9


@lru_cache(4096)
def _named(name: str, attrs: str) -> tuple[int | None, bool, int]:
    """(zone that the element gives, whether only if it isn't in an article, the least zone that an element inside must give to leave it); None where it says nothing.

    A main element leaves what only a class hides, and an article or main element leaves a form: some pages are one form."""
    at = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)} if attrs.strip() else {}
    role = at.get("role", "").lower()
    words = set(_WORDS.findall(" ".join((at.get("class", ""), at.get("id", ""), role)).lower()))
    if name in HIDDEN or "hidden" in at or at.get("aria-hidden", "").lower() == "true":
        return GONE, False, NEVER
    hints = words & HINTS
    if name in ("html", "body"):
        return None, False, NEVER
    if name == "article":
        return (GONE if words & {"comment", "comments", "reply"} else ARTICLE), False, NEVER
    if name == "main" or role == "main" or "articlebody" in at.get("itemprop", "").lower():
        return MAIN, False, NEVER
    if name in CHROME:
        return GONE, name == "header", MAIN if name == "form" else NEVER
    if hints and not words & OF_LAYOUT:
        return GONE, hints <= OF_ARTICLE, NEVER if hints & {"comment", "comments"} else ONLY_MAIN
    return (HELD if name in ("div", "section", "td") and words & CONTENT else None), False, NEVER


def blocks(html: str) -> list[tuple[int, str]]:
    """(zone, text) of every block that has text, in page order; an article begins with an empty one."""
    out: list[tuple[int, str]] = []
    pieces: list[str] = []
    stack: list[tuple[str, int, int]] = []
    inside: Counter[str] = Counter()
    zone, at = OPEN, 0

    def close() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                out.append((zone, text))

    def pop(to: int) -> None:
        nonlocal zone
        for name, _, _ in stack[to:]:
            inside[name] -= 1
        del stack[to:]
        now = stack[-1][1] if stack else OPEN
        if now != zone:
            close()
            zone = now

    def add(text: str) -> None:
        if text:
            pieces.append(unescape(text) if "&" in text else text)

    for m in _TOKEN.finditer(html):
        add(html[at : m.start()])
        at = m.end()
        if not m["name"]:
            if m["raw"] and m["raw"].lower() in BLOCKS:
                close()
            continue
        name = m["name"].lower()
        if name in BLOCKS:
            close()
        if m["end"]:
            if inside[name]:
                k = max(i for i, (n, _, _) in enumerate(stack) if n == name)
                if name in CONTAINERS or not any(n in CONTAINERS for n, _, _ in stack[k + 1 :]):
                    pop(k)
            continue
        if name in VOID:
            continue
        if stack and stack[-1][0] == "p" and name in BLOCKS or stack and stack[-1][0] == name == "li":
            pop(len(stack) - 1)
        given, outside_only, leaves = _named(name, m["attrs"] or "")
        now, hidden = zone, stack[-1][2] if stack else NEVER
        if given is not None and zone != GONE and not (outside_only and zone >= HELD):
            now = GONE if given == GONE else max(given, zone)
        elif zone == GONE and given is not None and (given == MAIN and hidden in (MAIN, ONLY_MAIN) or given == ARTICLE and hidden == MAIN):
            now = given
        if name in CONTAINERS or now != zone or inside[name]:
            if not (m["attrs"] or "").endswith("/") or name in CONTAINERS:
                stack.append((name, now, leaves if now == GONE and zone != GONE else hidden if now == GONE else NEVER))
                inside[name] += 1
                if now != zone:
                    close()
                    zone = now
                    if now == ARTICLE:
                        out.append((now, ""))
    add(html[at:])
    close()
    return out


@lru_cache(1 << 16)
def _word(word: str) -> int:
    return int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def stream(page: list[tuple[int, str]]) -> np.ndarray:
    """Hashes of the words outside article and main elements, in page order."""
    return np.array([_word(w) for zone, text in page if zone < MAIN for w in text.split()], np.uint64)


def runs(words: np.ndarray, host: int) -> np.ndarray:
    """A hash for each run of RUN words and the host, by its first word."""
    if len(words) < RUN:
        return np.zeros(0, np.int64)
    n = len(words) - RUN + 1
    h = np.full(n, np.uint64(host & (1 << 64) - 1))
    for k in range(RUN):
        h = mix(h ^ (words[k : k + n] + np.uint64(k + 1)))
    return h.view(np.int64)


def main_text(page: list[tuple[int, str]], starts: np.ndarray) -> tuple[str, int, int]:
    """(text, words outside, covered ones) of a page whose repeated runs begin at these words of its stream."""
    counts = [len(text.split()) if zone < MAIN else 0 for zone, text in page]
    total = sum(counts)
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + RUN, total), -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    best = max((zone for zone, _ in page), default=GONE)
    if best == HELD and 2 * sum(n for (zone, _), n in zip(page, counts) if zone == HELD) < sum(n for (zone, _), n in zip(page, counts) if zone > GONE):
        page, best = [(min(zone, OPEN), text) for zone, text in page], OPEN
    if best >= MAIN:
        kept = [text for zone, text in page if zone == best and text]
    else:
        ends = np.cumsum([0, *counts])
        by_block = covered[ends[1:]] - covered[ends[:-1]]
        open_ = [k for k, (zone, _) in enumerate(page) if zone == best and zone > GONE]
        size = sum(counts[k] for k in open_)
        copy = size > 0 and sum(by_block[k] for k in open_) >= COPY * size
        kept = [page[k][1] for k in open_ if copy or 2 * by_block[k] < counts[k]]
    return " ".join(kept), total, int(covered[-1])


# --- suffix arrays ------------------------------------------------------------------------------


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, length that each shares with the one before) of an array of integers, by doubling.

    Ranks of the prefixes of 1, 2, 4 ... tokens are kept: two neighbours' common length is put together from
    the largest of them downwards."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    ranks, step = [rank], 1
    while step < n and rank.max() < n - 1:
        after = np.zeros(n, np.int64)
        after[:-step] = rank[step:] + 1
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1]
        ranks.append(rank)
        step <<= 1
    order = np.argsort(rank, kind="stable")
    a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(max(n - 1, 0), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        ok = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[ok] = ranks[k][a[ok]] == ranks[k][b[ok]]
        step = same.astype(np.int64) << k
        a, b, common = a + step, b + step, common + step
    return order, np.concatenate([[0], common])[:n]


def shard_classes(streams: list[np.ndarray], host: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, smallest, largest stream) of all suffixes of the streams by their first RUN words. A stream is told by a hash of it."""
    ids = np.array([int(np.bitwise_xor.reduce(mix(s + np.arange(1, len(s) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))) if len(s) else 0 for s in streams], np.uint64).view(np.int64)
    words = np.unique(np.concatenate([np.zeros(0, np.uint64), *streams]), return_inverse=True)[1]
    sizes = np.array([len(s) for s in streams], np.int64)
    begin = np.cumsum(sizes) - sizes
    apart = [np.append(words[b : b + n], len(words) + k) for k, (b, n) in enumerate(zip(begin, sizes))]  # each stream ends in a token of its own
    tokens = np.concatenate(apart) if apart else np.zeros(0, np.int64)
    page = np.repeat(np.arange(len(streams)), sizes + 1)
    room = np.repeat(np.cumsum(sizes + 1), sizes + 1) - 1 - np.arange(len(tokens))
    hashes = np.concatenate([np.concatenate([runs(s, host), np.zeros(len(s) + 1 - max(0, len(s) - RUN + 1), np.int64)]) for s in streams] or [np.zeros(0, np.int64)])
    order, common = suffix_array(tokens)
    long_ = room[order] >= RUN  # a suffix that shares RUN words with another is long, and so are all of its class
    first = np.flatnonzero(long_ & (common < RUN))
    if not len(first):
        return (np.zeros(0, np.int64),) * 3
    owner = ids[page[order]]
    low = np.where(long_, owner, np.iinfo(np.int64).max)
    high = np.where(long_, owner, np.iinfo(np.int64).min)
    return hashes[order[first]], np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)


# --- Spark ------------------------------------------------------------------------------------------


def host_of(url: Column) -> Column:
    """What follows the first `://`, up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substr(url, instr(url, '://') + 3)")).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def _host() -> Column:
    return F.xxhash64(host_of(F.col("url"))).alias("host")


def streams(pages: DataFrame) -> DataFrame:
    """host, page, n, words: the token stream of each page that has one of RUN words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [stream(blocks(h or "")) for h in batch.column("html").to_pylist()]
            keep = [k for k, s in enumerate(made) if len(s) >= RUN]
            rows = [batch.column("host").take(pa.array(keep, pa.int64())), pa.array([len(made[k]) for k in keep], pa.int64()), pa.array([made[k].tobytes() for k in keep], pa.binary())]
            yield pa.RecordBatch.from_arrays(rows, ["host", "n", "words"])

    return pages.select(_host(), "html").mapInArrow(run, "host long, n long, words binary")


def repeated_runs(pages: DataFrame, tables: Tables, shard_words: int = SHARD_WORDS) -> DataFrame:
    """run: the classes of RUN words and host that begin in two different streams."""
    rows = tables.write(streams(pages), "streams")
    shards = rows.groupBy("host").agg(F.ceil(F.sum("n") / F.lit(shard_words)).cast("long").alias("shards"))
    dealt = rows.join(shards, "host").withColumn("shard", F.pmod(F.xxhash64("words"), F.col("shards")))

    def classes(rows: pa.Table) -> pa.Table:
        made = [np.frombuffer(w, np.uint64) for w in rows.column("words").to_pylist()]
        return pa.table(list(shard_classes(made, rows.column("host")[0].as_py())), ["run", "low", "high"])

    found = dealt.select("host", "shard", "words").groupBy("host", "shard").applyInArrow(classes, "run long, low long, high long")
    return found.groupBy("run").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("run")


_FOUND = "text string, n_chars long, words_outside long, words_repeated long"


def _finished(batch: pa.RecordBatch, starts: Iterator[np.ndarray], read: list[list[tuple[int, str]]]) -> pa.RecordBatch:
    rows = [main_text(page, s) for page, s in zip(read, starts)]
    cols = [pa.array([r[0] for r in rows], pa.string()), *(pa.array(x, pa.int64()) for x in ([len(r[0]) for r in rows], [r[1] for r in rows], [r[2] for r in rows]))]
    return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *cols], ["page_id", "url", "text", "n_chars", "words_outside", "words_repeated"])


def main_texts(pages: DataFrame, shard_words: int = SHARD_WORDS, most: int = MOST_CLASSES) -> DataFrame:
    """page_id, url, text, n_chars, and the words outside article and main elements: how many there are, and how many the host repeats."""
    spark = pages.sparkSession
    prepare(spark)
    with Tables(spark) as tables:
        repeated = tables.write(repeated_runs(pages, tables, shard_words), "repeated")
        few = repeated.count() <= most
        if few:
            known = np.sort(repeated.toPandas()["run"].to_numpy(np.int64))
        else:
            tables.keep(repeated)
    rows = pages.select("page_id", "url", "html", _host())
    kinds = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType([T.StructField(c, kinds[c]) for c in ("page_id", "url")] + T.StructType.fromDDL(_FOUND).fields)
    if few:
        sent = spark.sparkContext.broadcast(known)  # at most 8 bytes for each of `most` classes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                read = [blocks(h or "") for h in batch.column("html").to_pylist()]
                found = (np.flatnonzero(_held(runs(stream(page), host), sent.value)) for page, host in zip(read, batch.column("host").to_pylist()))
                yield _finished(batch, found, read)

        return rows.mapInArrow(run, schema)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [runs(stream(blocks(h or "")), host) for h, host in zip(batch.column("html").to_pylist(), batch.column("host").to_pylist())]
            row = batch.column("row").take(pa.array(np.repeat(np.arange(len(made)), [len(r) for r in made]), pa.int64()))
            at = np.concatenate([np.arange(len(r)) for r in made]) if made else []
            yield pa.RecordBatch.from_arrays([row, pa.array(at, pa.int64()), pa.array(np.concatenate(made) if made else [], pa.int64())], ["row", "at", "run"])

    rows = rows.withColumn("row", F.xxhash64("page_id", "url", "html"))  # equal rows have equal runs
    begins = rows.select("row", "html", "host").distinct().mapInArrow(spread, "row long, at long, run long").join(repeated, "run", "left_semi")
    begins = begins.groupBy("row").agg(F.collect_set("at").alias("starts"))

    def run_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [blocks(h or "") for h in batch.column("html").to_pylist()]
            yield _finished(batch, (np.array(sorted(s or []), np.int64) for s in batch.column("starts").to_pylist()), read)

    return rows.join(begins, "row", "left").select("page_id", "url", "html", "starts").mapInArrow(run_with, schema)


def _held(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the known ones, in order."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values
