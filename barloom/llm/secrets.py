"""Secret scan: fixed patterns, and the guess cost of values in credential contexts.

The cost of a value is the base-10 logarithm of the guesses an informed attacker needs:
the cheapest way to write it as words, dates, repeats, keyboard walks and brute-force
spans, found by dynamic programming over its positions. Values that cost more than a
threshold are reported besides what the fixed patterns find. Words are ranked by how often all documents
use them outside such values, after the fixed placeholders.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import inf, log10

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Wider contexts than ASSIGN; the value runs to white space, a quote or a bracket.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth(?:orization)?|credentials?|private[_-]?key)["']?[\x20\t]*(?::=|=>|[:=])[\x20\t]*(?:(?:bearer|basic)[\x20\t]+)?["']?([^\s"'<>(){}\[\],;|]{6,})""",
    re.I | re.A,
)
_CONTEXT_WORDS = re.compile(r"pass|pwd|secret|token|key|auth|credential", re.I | re.A)
KINDS = ("assign", "access", "hex", "guess")
#: Values that cost fewer guesses than 10 to this power are placeholders and plain words.
COST = 8.0

# Passwords and placeholders that attackers try before any other word, the likeliest first.
PLACEHOLDERS = """password admin letmein welcome qwerty monkey dragon master login hello secret love
princess football baseball sunshine shadow superman batman access changeme default guest user root
system server database token apikey key value none null true false test testing demo example sample
your here enter insert placeholder redacted hidden private public string xxxx todo foo bar baz""".split()
#: Words of documents in the dictionary at most, the most frequent ones; letters of a word.
MOST_WORDS, SHORTEST, LONGEST = 20_000, 3, 20
_LEET = str.maketrans("430157$@!", "aeoistsai")
# Rows of a keyboard.
_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_KEY_ROW, _KEY_PLACE = np.full(129, -9), np.full(129, -9)
for _r, _row in enumerate(_ROWS):
    for _k, _c in enumerate(_row):
        _KEY_ROW[ord(_c)], _KEY_PLACE[ord(_c)] = _r, _k
_YEAR = re.compile(r"(?:19|20)\d\d")
_DATE = re.compile(r"\d{1,4}([-/._]?)\d{1,2}\1\d{1,4}")
_DIGIT = re.compile(r"\d")
_WORD = re.compile(r"[^\W\d_]+")
_TWO, _WALK, _TURN, _DAYS, _YEARS = log10(2), log10(47), log10(8) / 2, log10(119 * 365), log10(119)


class Words:
    """Ranks of words from 1, and the automaton that finds them all in one pass."""

    def __init__(self, ranks: dict[str, int]):
        self.ranks = ranks
        self._found = None

    def __getstate__(self) -> dict:
        return {"ranks": self.ranks, "_found": None}

    def inside(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(start, end, rank) of every word that stands in the text."""
        if self._found is None:
            self._found = ahocorasick.Automaton()
            for w, rank in self.ranks.items():
                self._found.add_word(w, (len(w), rank))
            self._found.make_automaton()
        if self.ranks:
            for last, (size, rank) in self._found.iter(text):
                yield last + 1 - size, last + 1, rank


def ranked(words: list[str]) -> Words:
    """Placeholders, then these words, likeliest first."""
    every = dict.fromkeys([*PLACEHOLDERS, *words])
    return Words({w: k + 1 for k, w in enumerate(every)})


FIXED_WORDS = ranked([])


def _run(same: np.ndarray) -> np.ndarray:
    """How many true values begin at each place."""
    n = len(same)
    stop = np.where(same, n, np.arange(n))
    return np.minimum.accumulate(stop[::-1])[::-1] - np.arange(n)


def _alone(value: str, points: np.ndarray, mixed: bool) -> np.ndarray:
    """Brute-force cost of each character."""
    out = np.full(len(points), log10(33))
    out[(points >= 48) & (points < 58)] = 1.0
    letter = ((points | 32) >= 97) & ((points | 32) <= 122)
    out[letter] = log10(26) + (_TWO if mixed else 0.0)
    for i in np.flatnonzero(points > 127).tolist():
        out[i] = 1.0 if value[i].isdigit() else log10(100) + (_TWO if mixed and value[i].isalpha() else 0.0)
    return out


def _jumps(low: str, points: np.ndarray, alone: np.ndarray) -> list[tuple[list[int], list[float]]]:
    """Repeats and walks: for each kind, where the one that begins at each place ends (0: none does), and its cost."""
    n, out = len(points), []
    before = np.concatenate([[0.0], np.cumsum(alone)])
    same = {u: np.append(_run(points[:-u] == points[u:]), np.zeros(min(u, n), np.int64)) if n > u else np.zeros(n, np.int64) for u in (1, 2, 3, 4)}
    at = np.arange(n)
    for u in (1, 2, 3, 4):
        copies = same[u] // u + 1
        # a unit that repeats a shorter one is that one's repeat
        ok = (copies >= (3 if u < 3 else 2)) & ~np.logical_or.reduce([same[d] >= u - d for d in (1, 2) if d < u and u % d == 0] or [np.zeros(n, bool)])
        if ok.any():
            cost = before[np.minimum(at + u, n)] - before[:-1] + np.log10(copies)
            out.append((np.where(ok, at + copies * u, 0).tolist(), cost.tolist()))
    if n < 3:
        return out
    key = np.minimum(points, 128)
    down, along = np.diff(_KEY_ROW[key]), np.diff(_KEY_PLACE[key])
    known = _KEY_ROW[key] >= 0
    near = known[1:] & known[:-1] & (np.abs(down) <= 1) & (np.abs(along) <= 1) & ((down != 0) | (along != 0))
    turns = np.concatenate([[0, 0], np.cumsum((down[1:] != down[:-1]) | (along[1:] != along[:-1]))])
    step = np.diff(points.astype(np.int64))
    line = (np.abs(step) == 1) & np.append(step[1:] == step[:-1], False)
    lines = _run(line)
    lines = np.where(np.abs(step) == 1, lines + 1, 0)  # the last step of a line has no next one
    for steps, turning in ((_run(near), True), (lines, False)):
        ok = steps >= 2
        if ok.any():
            first = np.arange(n - 1)
            cost = _WALK + np.log10(np.maximum(1, steps))
            if turning:
                cost = cost + _TURN * (1 + turns[np.maximum(first + steps, first + 1)] - turns[first + 1])
            out.append((np.append(np.where(ok, first + steps + 1, 0), 0).tolist(), np.append(cost, 0.0).tolist()))
    return out


def guess_cost(value: str, words: Words = FIXED_WORDS) -> float:
    """log10 of the guesses for the cheapest segmentation; 0 for the empty value. Time grows with the length.

    Word: its rank, times two for each of capitals and substitutes. Date: about 119 years of
    days, a year alone 119. Repeat: a unit of one or two characters said at least three times, of three or four
    said twice, as often as it goes on: the cost of the unit times the number of copies. Walk over three or more
    neighbouring keys or consecutive characters, as far as it goes on: the start, the length and its
    turns. Brute force: 10, 26 or 33 choices a character, and case counts as a
    choice of its own if the value mixes it. Each segment costs a further factor of two.
    """
    n = len(value)
    if not n:
        return 0.0
    low = value.lower()
    if len(low) != n:
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    mixed = low != value and value.upper() != value
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    alone = _alone(value, points, mixed)
    some: dict[int, list[tuple[int, float]]] = {}
    plain = low.translate(_LEET)
    for text in {low, plain}:
        for i, j, rank in words.inside(text):
            extra = (_TWO if value[i:j] != low[i:j] else 0.0) + (_TWO if text[i:j] != low[i:j] else 0.0)
            some.setdefault(i, []).append((j, log10(rank + 1) + extra))
    for m in _DIGIT.finditer(low):
        i = m.start()
        d = _DATE.match(low, i, min(n, i + 10))
        if d and d.end() - i >= 6:
            some.setdefault(i, []).append((d.end(), _DAYS + (2 * _TWO if d[1] else 0.0)))
        if _YEAR.match(low, i):
            some.setdefault(i, []).append((i + 4, _YEARS))
    jumps = _jumps(low, points, alone)
    best, brute = [inf] * (n + 1), inf  # of all segmentations up to a place, and of those that end in brute force
    best[0] = 0.0
    for i, cost in enumerate(alone.tolist()):
        here = best[i] + _TWO
        brute = cost + (brute if brute < here else here)
        if brute < best[i + 1]:
            best[i + 1] = brute
        for ends, costs in jumps:
            j = ends[i]
            if j and here + costs[i] < best[j]:
                best[j] = here + costs[i]
        if i in some:
            for j, cost in some[i]:
                if here + cost < best[j]:
                    best[j] = here + cost
    return best[n]


def dictionary(docs: DataFrame, most: int = MOST_WORDS) -> Words:
    """The ranks of the `most` most frequent words of all documents, values in credential contexts left out.

    Words are runs of SHORTEST to LONGEST letters, in lower case; ties go by the word. Counts are added up on
    the executors; only the ranked words reach the driver.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            some = {w: n for w, n in count.items() if SHORTEST <= len(w) <= LONGEST}
            count.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(some), pa.string()), pa.array(list(some.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text:
                    count.update(_WORD.findall((CONTEXT.sub(" ", text) if _CONTEXT_WORDS.search(text) else text).lower()))
            if len(count) > 200_000:
                yield told()
        if count:
            yield told()

    sums = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return ranked([r["word"] for r in sums.orderBy(F.desc("n"), "word").limit(most).collect()])


def find_spans(text: str, cost: float = COST, words: Words = FIXED_WORDS) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base, added) spans as (start, end, kind), code points, end exclusive, in order of start."""
    base, added = [], []
    if _CONTEXT_WORDS.search(text):
        base += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        for m in CONTEXT.finditer(text):
            if guess_cost(m[1], words) >= cost:
                added.append((m.start(1), m.end(1), "guess"))
    if "AKIA" in text:
        base += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    order = lambda s: (s[0], KINDS.index(s[2]))
    return sorted(base, key=order), sorted(added, key=order)


def find_secrets(docs: DataFrame, cost: float = COST, words: Words = FIXED_WORDS) -> DataFrame:
    """doc_id, base, added: spans of every whole text, one row for each row of docs.

    words: see dictionary(). Null and empty texts have no spans. A null doc_id stays null, repeated rows each get
    theirs. Other columns are not read. Patterns are matched from the left without overlap
    within a kind; spans of different kinds may overlap. Time grows with the length of a text.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(words)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("start", "end", "kind")
        for batch in batches:
            found = [find_spans(t or "", cost, shared.value) for t in batch.column("text").to_pylist()]
            cols = [pa.array([[dict(zip(names, s)) for s in f[k]] for f in found], kind) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "base", "added"])

    spans = "array<struct<start:long,end:long,kind:string>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, base {spans}, added {spans}")
