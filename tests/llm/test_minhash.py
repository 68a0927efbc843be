import random

import numpy as np
import pyarrow as pa

from barloom.llm import minhash
from barloom.llm.common import Tables, components


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in low).split(" ") if w]


def shingles(text, width):
    w = words(text)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute(rows, width, percent):
    """{doc_id: component} of unique ids."""
    sets = {i: shingles(t, width) for i, t in rows}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def near_copies(n_groups, size, seed=3, length=120):
    rng = random.Random(seed)
    vocab = [f"v{k}" for k in range(4000)]
    out = []
    for _ in range(n_groups):
        base = [rng.choice(vocab) for _ in range(length)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, 7)):
                w[rng.randrange(length)] = rng.choice(vocab)
            out.append(" ".join(w))
    rng.shuffle(out)
    return list(enumerate(out))


def judged(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: r for r in minhash.near_duplicates(df, **kw).collect()}


def test_matches_brute_force(spark):
    rows = near_copies(25, 8)
    top, sizes = brute(rows, 4, 80)
    got = judged(spark, rows, width=4)
    assert {i: r["component_id"] for i, r in got.items()} == top
    assert {i: r["n_shingles"] for i, r in got.items()} == sizes
    assert all(r["kept"] == (i == top[i]) for i, r in got.items())


def test_groups_beyond_a_block(spark):
    rows = near_copies(2, 60, seed=5)
    top, _ = brute(rows, 4, 80)
    for block in (7, 512):
        got = judged(spark, rows, width=4, block=block)
        assert {i: r["component_id"] for i, r in got.items()} == top


def test_short_texts_differ_from_shingles(spark):
    got = judged(spark, [(1, "a b c"), (2, "A\tB\nC"), (3, "a b c d"), (4, "a b"), (5, "c b a")], width=4)
    assert [got[i]["component_id"] for i in range(1, 6)] == [1, 1, 3, 4, 5]


def test_edges(docs):
    out = minhash.near_duplicates(docs)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    rows = out.collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[2]["component_id"] == by[3]["component_id"] == 1 and by[8]["component_id"] == 7
    assert by[4]["n_shingles"] == by[5]["n_shingles"] == by[6]["n_shingles"] == 0 and by[4]["kept"] and by[5]["kept"]
    assert sum(r["doc_id"] == 3 for r in rows) == 2
    assert all(r["component_id"] is None and r["kept"] for r in rows if r["doc_id"] is None)
    assert by[9]["component_id"] == by[10]["component_id"] == 9
    kept = minhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [1, 4, 5, 6, 7, 9, 11, 12]
    assert kept.where("doc_id is null").count() == 2


def test_empty_table(spark, docs):
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_missed_with_negligible_chance():
    from math import comb

    assert sum(comb(32, i) * 0.8**i * 0.2 ** (32 - i) for i in range(13)) < 1e-6


def test_sets_do_not_depend_on_neighbours():
    texts = ["a b c d e", None, "", "x\ny z é w", "q" * 100]
    alone = [next(minhash.shingle_sets(pa.array([t], pa.string()), 4)) for t in texts]
    together = list(minhash.shingle_sets(pa.array(texts, pa.string()), 4))
    assert all(np.array_equal(a, b) for a, b in zip(alone, together))


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 100), (7, 7)], "a long, b long")
    with Tables(spark) as tables:
        got = {r["id"]: r["comp"] for r in components(edges, tables).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 200: 100}
