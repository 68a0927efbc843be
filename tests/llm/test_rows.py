"""Rows that share a doc_id, columns of any name, hashes that no pattern defeats, and tables that go."""

import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from barloom.llm import common, lines, minhash
from barloom.llm.common import Tables, group_links, shared_dir
from test_lines import distance

NAMES = ("_drop", "_drop_id", "_gone", "gone", "rest", "row", "whole", "line", "check", "class", "doc", "text2", "a.b", "_root", "group", "node", "drops")


def morse(n, a, b):
    x = a
    for _ in range(n):
        x += "".join(b if c == a else a for c in x)
    return x


def test_rows_of_one_doc_id_lose_only_their_own_lines(spark):
    rows = [(1, "first line of all\nsecond"), (2, "only here"), (2, "first line of all"), (2, "first line of all"), (3, "second\nkeep me"), (3, "keep me too, I am other\nsecond"), (None, "second")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted((r["doc_id"] or 0, r["text"]) for r in lines.without_repeats(df, short=True).collect())
    assert got == [(0, "second"), (1, "first line of all\nsecond"), (2, "only here"), (3, "keep me"), (3, "keep me too, I am other")]


def test_columns_of_any_name_stay(spark):
    rows = [(i, t, *(f"{x}{i}" for x in NAMES)) for i, t in enumerate(["same old line\nalpha", "same old line\nbeta", "same old line\nalpha"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{x}` string" for x in NAMES))
    for out, want in ((lines.without_repeats(df, short=True), {0: "same old line\nalpha", 1: "beta"}), (minhash.without_near_duplicates(df), {0: "same old line\nalpha", 1: "same old line\nbeta"})):
        assert out.columns == df.columns
        left = {r["doc_id"]: r for r in out.collect()}
        assert {i: r["text"] for i, r in left.items()} == want
        assert all(tuple(r)[2:] == tuple(f"{x}{i}" for x in NAMES) for i, r in left.items())


def test_thue_morse_lines_and_words_differ(spark):
    a, b = morse(11, "a", "b"), morse(11, "b", "a")
    assert a != b and len(a) == 2048
    df = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    assert {(r["doc_id"], r["first_doc"]) for r in lines.repeated_lines(df, short=True).collect()} == {(3, 1)}
    sets = list(minhash.shingle_sets(pa.array([a, b, a.upper()]), 4))
    assert sets[0][0] != sets[1][0] and sets[0][0] == sets[2][0]


def test_words_hash_by_letters_and_places():
    words = [b"ab", b"ba", b"a", b"b", b"aab", b"aba", b"abab", b"baba", "é".encode(), b"e", b"x" * 5000, b"x" * 5001]
    text = np.frombuffer(b" ".join(words), np.uint8)
    found, at = common.space_words(text, np.array([0, len(text)]))
    assert len(set(found.tolist())) == len(words) == at[1]


def whole_sizes(tmp):
    return [p for p in Path(tmp).iterdir() if p.name.startswith("barloom-")]


def test_tables_go_with_the_run(spark):
    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = len(whole_sizes(folder))
    df = spark.createDataFrame([(1, "one two three four five six"), (2, "one two three four five six seven"), (3, "x")], "doc_id long, text string")
    assert minhash.near_duplicates(df).count() == 3 and lines.repeated_lines(df, short=True).count() == 0
    assert len(whole_sizes(folder)) == before + 2  # the two results
    with pytest.raises(ZeroDivisionError), Tables(spark) as tables:
        tables.write(df, "x")
        raise ZeroDivisionError
    assert len(whole_sizes(folder)) == before + 2


@pytest.mark.parametrize("block", [4, 9, 100])
def test_group_links_see_every_pair(spark, block):
    """Numbers within 3 of each other, in groups that overlap, of one component or many."""
    rng = random.Random(block)
    rows = [(g, n) for g, (size, top) in enumerate([(1, 9), (30, 40), (60, 4000), (40, 45), (12, 900)]) for n in rng.sample(range(top), size)]

    def work(part):
        members = common.Members(part)
        for x in range(len(members)):
            other = np.arange(x + 1, len(members))
            for y in other[members.pairs(x, other)].tolist():
                if abs(members.node[x] - members.node[y]) <= 3:
                    members.trees.join(x, y)
        return members.done()

    with Tables(spark) as tables:
        df = tables.write(spark.createDataFrame(rows, "group long, node long"), "in")
        found = common.components(group_links(df, work, [], tables, block), tables)
        got = {r["id"]: r["comp"] for r in found.collect()}
    top = {n: n for _, n in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for g, a in rows:
        for h, b in rows:
            if g == h and a < b and b - a <= 3:
                p, q = sorted((find(a), find(b)))
                top[q] = p
    assert {n: got.get(n, n) for n in top} == {n: find(n) for n in top}


def test_lines_of_a_hot_posting(spark):
    """Lines that share a segment but are mostly unlike: more than a block of them, every link found."""
    rng = random.Random(2)
    kinds = ["the same long opening of every line " + "".join(rng.choice("abcd") for _ in range(9)) for _ in range(150)]
    rows = list(enumerate(kinds))
    top = {x: x for x in kinds}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(kinds):
        for b in kinds[i + 1 :]:
            if a != b and distance(a[36:], b[36:]) <= 2:
                top[find(b)] = find(a)
    first = {}
    for i, x in rows:
        first.setdefault(find(x), i)
    want = {(i, first[find(x)]) for i, x in rows if first[find(x)] != i}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert want and {(r["doc_id"], r["first_doc"]) for r in lines.repeated_lines(df, block=16).collect()} == want
