import pytest

#: Columns whose names operators use inside, and usual ones in other cases.
CLASHES = ("spot", "rep", "set_key", "key", "a", "b", "line", "n_words", "spans", "Items", "KEPT", "component_id", "_n", "_g", "block", "score", "turns")


@pytest.fixture(scope="session")
def docs(spark):
    """Rows of documents: nulls, empty and blank texts, ties, repeated rows, a very long text, clashing columns."""
    base = "the quick brown fox jumps over the lazy dog and runs far away from the old grey wolf today"
    long_ = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    rows = [
        (1, base, "en", "s1"), (2, base, "en", "s1"), (3, base + " again", "en", "s2"), (3, base + " again", "en", "s2"), (4, None, None, None),
        (5, "", "en", "s1"), (6, " \t\n ", "de", "s3"), (None, base, "en", "s1"), (None, None, None, None), (7, long_, "en", "s2"),
        (8, long_ + " tail", "fr", "s2"), (9, "One", "fr", "s9"), (10, "one", "fr", "s9"), (11, "123 456", "en", "s1"), (12, "écoute ça, où est-il né?\nDas Mädchen läuft über die Straße", "fr", "s1"),
    ]
    wide = [(i, t, lang, src, len(t or ""), *("x" for _ in CLASHES)) for i, t, lang, src in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame(wide, schema).repartition(3)
