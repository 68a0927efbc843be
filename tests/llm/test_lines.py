import random

from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm import lines as L
from barloom.llm.common import Rolling


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


text = st.text("abé", max_size=14)


@settings(max_examples=400, deadline=None)
@given(text, text, st.integers(1, 4))
def test_banded_distance(a, b, k):
    assert L.within(a, b, k) == (distance(a, b) <= k)


@settings(max_examples=200, deadline=None)
@given(st.text("abcdefg", min_size=9, max_size=30), st.integers(1, 3), st.data())
def test_close_lines_share_a_posting(a, k, data):
    b = list(a)
    for _ in range(data.draw(st.integers(0, k))):
        i = data.draw(st.integers(0, max(0, len(b) - 1)))
        kind = data.draw(st.integers(0, 2))
        b[i : i + (kind > 0)] = ["z"] if kind < 2 else []
    b = "".join(b)
    if distance(a, b) > k or len(b) <= k:
        return
    points, offsets = L.code_points([a, b])
    keys = L.postings(Rolling(points), offsets[:-1], offsets[1:] - offsets[:-1], k)
    first, second = ({int(x[i]) for x in keys if x[i]} for i in (0, 1))
    assert first & second


def brute(rows, edits, min_chars):
    seen = [(d, n, x) for d, t in rows for n, x in enumerate((t or "").split("\n")) if len(x) >= min_chars]
    kinds = sorted({x for _, _, x in seen})
    top = {x: x for x in kinds}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(kinds):
        for b in kinds[i + 1 :]:
            if abs(len(a) - len(b)) <= edits and distance(a, b) <= edits:
                top[find(b)] = find(a)
    first = {}
    for d, n, x in seen:
        first[find(x)] = min(first.get(find(x), (d, n)), (d, n))
    return {(d, n, *first[find(x)]) for d, n, x in seen if (d, n) != first[find(x)]}


def lines_case(seed=4, n=60):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(5, 40))) for _ in range(25)]

    def touched(x):
        x = list(x)
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            i = rng.randrange(len(x) + 1)
            x[i : i + rng.randint(0, 1)] = rng.choice(["", "q", "é"])
        return "".join(x)

    return [(i, "\n".join(touched(rng.choice(pool)) for _ in range(rng.randint(0, 6)))) for i in range(n)]


def test_matches_brute_force(spark):
    rows = lines_case()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for edits, block in ((2, 512), (1, 5)):
        got = L.repeated_lines(df, edits=edits, min_chars=12, block=block)
        assert {(r["doc_id"], r["line_no"], r["first_doc"], r["first_line"]) for r in got.collect()} == brute(rows, edits, 12)


def test_rebuilt_text(spark):
    rows = lines_case(6)
    df = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    gone = {(d, n) for d, n, _, _ in brute(rows, 2, 12)}
    out = {r["doc_id"]: r for r in L.without_repeats(df, 2, 12).collect()}
    for i, t in rows:
        parts = t.split("\n")
        kept = [x for n, x in enumerate(parts) if (i, n) not in gone]
        want = "\n".join(kept)
        if len(kept) < len(parts) and not want.strip():
            assert i not in out
        else:
            assert out[i]["text"] == want and out[i]["n_chars"] == len(want)


def test_edges(docs):
    out = L.repeated_lines(docs)
    assert out.columns == ["doc_id", "line_no", "class", "first_doc", "first_line"]
    got = {(r["doc_id"], r["line_no"]): (r["first_doc"], r["first_line"]) for r in out.collect()}
    assert got == {(2, 0): (1, 0), (None, 0): (1, 0)}
    left = L.without_repeats(docs)
    assert left.columns == docs.columns
    ids = sorted(r["doc_id"] for r in left.where("doc_id is not null").collect())
    assert ids == [1, 3, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12] and left.where("doc_id is null").count() == 2
    assert L.repeated_lines(docs.limit(0)).count() == 0 and L.without_repeats(docs.limit(0)).count() == 0
