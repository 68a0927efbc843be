import re
from collections import Counter
from itertools import permutations

from barloom.llm import audit as A

LABELS = "doc_id long, quality int, toxic int"


def brute(rows, labels):
    good, toxic = ({d for d, q, t in labels if (q, t)[k] == 1 and d is not None} for k in (0, 1))
    first = {}
    for d, text, _ in rows:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    docs = []
    for d, text, source in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), d is not None and d > first[t]]
        docs.append((source or "", {x for x, f in zip("ABCDE", fails) if f}, d in good, d in toxic))
    out, shapley = [], Counter()
    for part in {x[0] for x in docs}:
        for order in permutations("ABCDE"):
            left, gone = [x for x in docs if x[0] == part], []
            for step, x in enumerate(order, 1):
                cut = [y for y in left if x in y[1]]
                redundant = sum(x in y[1] for y in gone)
                left, gone = [y for y in left if x not in y[1]], gone + cut
                shapley[part, x] += len(cut)
                only = sum(y[1] == {x} for y in docs if y[0] == part)
                out.append((part, "".join(order), step, len(left), len(cut), redundant, only, sum(y[2] for y in cut), sum(y[3] for y in cut)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_brute_force(spark, docs):
    many = " ".join(f"w{i}" for i in range(300))
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    more = [(100 + i, (many + (" A&B" if i % 3 else "") + (" XYZ" * 40 if i % 4 else "") + f" {i % 6}") if i % 5 else "same " * 250, f"s{i % 3}") for i in range(60)]
    more += [(20, "   Ä\x1cb", "s1"), (101, more[1][1], "s2"), (101, more[1][1], "s1")]
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 160, 3)] + [(3, 1, None), (3, 0, 1), (None, 1, 1), (999, 1, 1)]
    df = docs.select("doc_id", "text", "source", "block", "Items").unionByName(spark.createDataFrame(more, "doc_id long, text string, source string"), allowMissingColumns=True)
    got = A.audit_documents(df, spark.createDataFrame(labels, LABELS))
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert got.columns == names
    assert sorted(tuple(r) for r in got.collect()) == brute(rows + more, labels)


def test_empty(spark, docs):
    assert A.audit_documents(docs.limit(0), spark.createDataFrame([], LABELS)).count() == 0
    assert A.audit_documents(docs, spark.createDataFrame([], LABELS)).where("good_lost + toxic_lost > 0").count() == 0


def test_intervals_are_the_orders_of_a_first_failure():
    for size in (1, 3, 5):
        letters = "ABCDE"[:size]
        ranked = A.orders(letters)
        assert ranked == ["".join(p) for p in permutations(letters)]
        want = set()
        for mask in range(1, 1 << size):
            for rank, order in enumerate(ranked):
                want.add((mask, rank, next(s for s, x in enumerate(order, 1) if mask >> letters.index(x) & 1)))
        assert {(m, r, s) for m, s, lo, hi in A.intervals(size) for r in range(lo, hi)} == want
