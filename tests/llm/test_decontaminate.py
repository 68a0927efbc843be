import random
import re

import numpy as np
from pyspark.sql import functions as F

from barloom.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        for k in range(max(1, len(v) - window + 1) if v else 0):
            part = v[k : k + window]
            for s in range(len(w) - len(part) + 1):
                if w[s : s + len(part)] == part:
                    hit |= set(range(s, s + len(part)))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def case(seed, n_docs=60, vocab=7, window=4):
    rng = random.Random(seed)
    voc = [f"W{i}" if i % 2 else f"é{i}" for i in range(vocab)]
    say = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(voc) for _ in range(n))
    items = [(i, say(rng.randint(0, 9))) for i in range(6)] + [(90, None), (91, "!?"), (5, say(6))]
    docs = [(i, say(rng.randint(0, 40))) for i in range(n_docs)]
    return docs, items


def test_suffix_array_and_index_are_exact():
    rng = np.random.default_rng(0)
    for n_sym, n in ((1, 40), (2, 300), (5, 500), (300, 400)):
        codes = np.append(rng.integers(0, n_sym + 1, n), 0).astype(np.int64)
        bits = max(1, int(n_sym).bit_length())
        order = D.suffix_array(codes, bits)
        ends = np.flatnonzero(codes == 0)

        def key(p):
            run = []
            while codes[p]:
                run.append((1, int(codes[p])))
                p += 1
            return [*run, (0, int(np.searchsorted(ends, p)))]

        assert order.tolist() == sorted(range(len(codes)), key=key)
        index = D.FMIndex(codes, n_sym)
        phrases = np.array([codes[s : s + 3] for s in range(n - 3) if all(codes[s : s + 3])][:50]).reshape(-1, 3)
        lo, hi = index.search(phrases, np.full(len(phrases), 3))
        for p, a, b in zip(phrases, lo, hi):
            want = [s for s in range(len(codes) - 2) if (codes[s : s + 3] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_matches_brute_force(spark):
    docs, items = case(1)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for chars in (8_000_000, 25):  # the second passes the documents through several blocks of the benchmark
        got = D.find_leaks(df, bench, window=4, block_chars=chars, shard_words=50).withColumn("n_hit", D.n_hit())
        for r in got.collect():
            text = dict(docs)[r["doc_id"]]
            assert (r["n_words"], r["n_hit"], list(r["items"])) == brute(text, items, 4), (chars, text)


def test_removal(spark):
    docs, items = case(2)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    clean = {i for i, t in docs if not brute(t, items, 4)[1]}
    for chars in (4_000_000, 25):
        assert {r["doc_id"] for r in D.without_leaks(df, bench, window=4, shard_words=40, block_chars=chars).collect()} == clean
        cut = {r["doc_id"]: r["text"] for r in D.without_leaks(df, bench, window=4, cut=True, block_chars=chars).collect()}
        for i, t in docs:
            n, hit, _ = brute(t, items, 4)
            if hit < n or not n:
                assert len(words(cut[i])) == n - hit and (hit or cut[i] == t)
            else:
                assert i not in cut


def test_edges(docs, spark):
    bench = spark.createDataFrame([(1, "the lazy dog and runs far away from the old grey wolf"), (None, "one"), (3, None)], "item_id long, text string")
    out = D.find_leaks(docs, bench)
    rows = out.collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert list(by[1]["items"]) == ["1"] and list(by[9]["items"]) == list(by[10]["items"]) == [""]
    assert by[4]["n_words"] == by[5]["n_words"] == 0 and not by[7]["items"]
    left = D.without_leaks(docs, bench)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == {4, 5, 6, None, 7, 8, 11, 12}
    empty = bench.limit(0)
    assert D.find_leaks(docs, empty).where(F.size("items") > 0).count() == 0
    assert D.find_leaks(docs.limit(0), bench).count() == 0
    assert D.without_leaks(docs, empty).count() == docs.count()
