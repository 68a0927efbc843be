import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from barloom.llm import manifest as M

H = lambda *parts: sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, more=0):
    n = None if row["n_chars"] is None else row["n_chars"] + more
    values = [None if v is None else str(v) for v in (row["doc_id"], row["source"], row["lang"], n, row["text"])]
    return H(*("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def tree(nodes):
    """(root, the siblings of every node), one whole level after the other."""
    at, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for k, p in enumerate(at):
            if p ^ 1 < len(nodes):
                paths[k].append((p ^ 1, nodes[p ^ 1]))
            else:
                paths[k].append((p + 1, ""))
            at[k] = p // 2
        nodes = [H(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
    return (nodes or [""])[0], paths


def folded(digest, place, path):
    for side, other in path:
        digest = H(other, digest) if side < place else H(digest, other)
        place //= 2
    return digest


def brute(rows):
    langs = defaultdict(list)
    for r in rows:
        langs[r["lang"]].append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for x in order:
        langs[x].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
    inner = {x: tree([leaf_of(r) for r in langs[x]]) for x in order}
    root, outer = tree([inner[x][0] for x in order])
    out = []
    for j, x in enumerate(order):
        for i, r in enumerate(langs[x]):
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            path, above = inner[x][1][i], outer[j]
            top = folded(folded(leaf_of(r, hit), i, path), j, above)
            out.append((r["doc_id"], leaf_of(r), inner[x][0], root, H(*(s for _, s in path + above)), top, top == root))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("levels", [2, 10])
def test_brute_force(spark, docs, levels):
    rows = [(i, f"t{i}", "en" if i % 3 else "de", "s", i if i % 5 else None) for i in range(70)] + [(i, "x", f"l{i}", "s", 3) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    some = docs.unionByName(df, allowMissingColumns=True)
    got = rows_of(M.manifest(some, levels))
    assert got == brute([r.asDict() for r in some.collect()])
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


def test_proofs_fold(spark):
    df = spark.createDataFrame([(i, str(i), "en", "s", i) for i in range(37)], "doc_id long, text string, lang string, source string, n_chars long")
    for r in M.manifest(df, 2).collect():
        assert M.fold(r["leaf"], r["proof"]) == r["root"] and M.fold(H("other"), r["proof"]) != r["root"]


def test_small_tables(spark, docs):
    assert M.manifest(docs.limit(0)).count() == 0
    one = spark.createDataFrame([(9_007_199_254_740_993, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    got = M.manifest(one).first()
    assert got["doc_id"] == 9_007_199_254_740_993 and got["leaf"] == got["subroot"] == got["root"] and got["proof_sha256"] == H("") and got["verified"]
