"""Lines under 40 characters: exact copies at every length, edits in proportion."""

import random

from barloom.llm import lines as L
from barloom.llm.queries import op9_line_dedup
from test_lines import distance, lines_case


def brute(rows, edits, min_chars):
    seen = [(d, n, x) for d, t in rows for n, x in enumerate(t.split("\n")) if x.strip()]
    kinds = sorted({x for _, _, x in seen})
    top = {x: x for x in kinds}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(kinds):
        for b in kinds[i + 1 :]:
            few = min(edits, min(len(a), len(b)) * edits // min_chars)
            if abs(len(a) - len(b)) <= few and distance(a, b) <= few:
                top[find(b)] = find(a)
    first = {}
    for d, n, x in seen:
        first[find(x)] = min(first.get(find(x), (d, n)), (d, n))
    return {(d, n, *first[find(x)]) for d, n, x in seen if (d, n) != first[find(x)]}


def test_every_length_against_brute_force(spark):
    rng = random.Random(8)
    rows = lines_case(5, 80) + [(100 + i, "\n".join(rng.choice(["}", "ab", "a b", " ", "\t　", "", "- x"]) for _ in range(4))) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for edits, min_chars, block in ((2, 30, 512), (3, 24, 5)):
        got = L.repeated_lines(df, edits, min_chars, block, short=True)
        assert {(r["doc_id"], r["line_no"], r["first_doc"], r["first_line"]) for r in got.collect()} == brute(rows, edits, min_chars)


def test_query_reports_short_copies(spark, tmp_path):
    rows = [(1, "Released under the MIT License.\n}"), (2, "other\nReleased under the MIT License."), (3, "}\n \n\nReleased under the MIT Licence.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["line_no"], r["first_doc"], r["first_line"]) for r in op9_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {(2, 1, 1, 0), (3, 0, 1, 1), (3, 3, 1, 0)}
