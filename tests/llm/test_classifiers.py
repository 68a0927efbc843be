import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barloom.llm import language, ngrams, quality
from barloom.llm.queries import op3_quality, op4_language_id

SF = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = op4_language_id(spark, SF).toPandas().merge(docs[["doc_id", "lang"]], on="doc_id")
    held = got[got["held_out"]]
    assert len(got) == len(docs) and len(held) > 200
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_quality_held_out(spark):
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    out = op3_quality(spark, SF).toPandas()
    assert out["score"].between(0, 1).all() and ((out["score"] >= 0.3) == (out["predicted"] == 1)).all()
    held = out[out["held_out"]].merge(labels, on="doc_id")
    good, bad = (held.loc[held["quality"] == q, "score"].to_numpy() for q in (1, 0))
    auc = np.mean(good[:, None] > bad[None, :])
    assert auc > 0.95 and ((held["score"] >= 0.3) == (held["quality"] == 1)).mean() > 0.93


def test_language_edges(docs):
    model = language.fit(docs)
    rows = language.identify(docs, model).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (4, 5, 6, 11))
    assert by[9]["lang_pred"] in ("en", "fr")
    left = language.accepted(docs, model)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} <= {1, 2, 3, 7, 8, 9, 10, 12, None}
    none = language.fit(docs.limit(0))
    assert none.languages == [] and {r["lang_pred"] for r in language.identify(docs, none).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0


def test_quality_edges(spark, docs):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, None), (None, 1), (9, 5), (12, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    by = {r["doc_id"]: r["score"] for r in rows}
    assert by[4] == by[5]
    one = quality.fit(docs, labels.where("quality = 1"))
    assert len({r["score"] for r in quality.score(docs, one).collect()}) == 1
    assert quality.score(docs.limit(0), model).count() == 0
    assert quality.fit(docs, labels.limit(0)).prior == 0.5


def test_dual_descent_separates():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 6))
    y = np.where(x @ np.array([2, -1, 0.5, 0, 0, 1.0]) + 0.3 > 0, 1.0, -1.0)
    rows = [(np.arange(6), r) for r in x]
    w, b = quality.descend(rows, y, np.ones(300) * 10, rounds=60)
    assert np.mean(np.sign(x @ w[:6] + b) == y) > 0.97


def grams(text):
    """The hashed blended spectrum of a text, by sets."""
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    two = {raw[i : i + 2] for i in range(len(raw) - 1)}
    three = {raw[i : i + 3] for i in range(len(raw) - 2)}
    hashed = {((int.from_bytes(g, "big") * 0x9E3779B1) & 0xFFFFFFFF) >> 16 for g in three}
    return {(1, b) for b in raw} | {(2, g) for g in two} | {(3, h) for h in hashed}


TEXTS = [
    ("en", "the cat sat on the mat and the dog ran"), ("en", "where is the house of the old man"), ("en", "they went there with them"), ("en", "this and that"),
    ("de", "der Hund und die Katze sind nicht da"), ("de", "das ist ein Haus und der Mann"), ("de", "wir gehen in die Stadt"), ("de", "und so weiter"),
    ("fr", "le chat est dans la maison de la ville"), ("fr", "où est la porte du jardin"), ("fr", "nous allons à la mer"), ("fr", "et ainsi de suite"),
]


def test_kernel_nystroem_and_ridge_by_hand():
    seen = np.zeros(ngrams.SLOTS, bool)
    model = language.train([ngrams.present(t.encode(), True, seen) for _, t in TEXTS], [x for x, _ in TEXTS], per_language=2, ridge=0.05)
    sets, names = [grams(t) for _, t in TEXTS], sorted({x for x, _ in TEXTS})
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    marks = [i for x in names for i in [k for k, (y, _) in enumerate(TEXTS) if y == x][:2]]
    k_nm = np.array([[kernel(a, sets[m]) for m in marks] for a in sets])
    k_mm = k_nm[marks]
    y = np.array([[1.0 if x == z else -1.0 for z in names] for x, _ in TEXTS])
    # the map's ridge regression is the same as this one over the landmarks: min |K_nm v - y|^2 + ridge v' K_mm v
    # every language has the same number of rows here, so each row weighs 1
    v = np.linalg.solve(k_nm.T @ k_nm + 0.05 * k_mm, k_nm.T @ y)
    told = ["the dog is here", "die Katze und das Haus", "la mer est belle", "x"]
    want = np.array([[kernel(grams(t), sets[m]) for m in marks] for t in told]) @ v
    got = model.kernel(*ngrams.batches_of(ngrams.present(t.encode(), True, seen) for t in told)) @ model.weights
    assert model.languages == names and np.abs(got - want).max() < 1e-6


def test_every_language_is_learned(spark):
    rows = [(i, f"l{i % 260}", f"{chr(0x4E00 + i % 260) * 3} {chr(0x4E00 + i % 260)}") for i in range(780)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4)
    model = language.fit(docs)
    assert len(model.languages) == 260
    out = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    assert out.where("lang = lang_pred").count() == 780


def test_letters_are_of_category_l(spark):
    import unicodedata

    for c in ["²", "½", "①", "Ⅷ", "1", "_", "a", "é", "中", "ʰ", "ª", "٣", "۞", "\u0301", "𝒜"]:
        assert ngrams.has_letter("1 " + c) == unicodedata.category(c).startswith("L"), c
    docs = spark.createDataFrame([(1, "²½①", "en"), (2, "hello there", "en"), (3, "salut toi", "fr")], "doc_id long, text string, lang string")
    by = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, language.fit(docs)).collect()}
    assert by == {1: "und", 2: "en", 3: "fr"}


LABELLED = [("good clean text about maps", 1), ("a fine text about good maps", 1), ("clean words", 1), ("bad spam spam spam spam", 0), ("buy spam now now now", 0), ("click here spam", 0), ("good spam", 1), ("good spam", 0)]


def test_ratios_and_descent_by_hand(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LABELLED)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, q) for i, (_, q) in enumerate(LABELLED)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    # log-count ratios by counting, in dense numpy
    seen = np.zeros(ngrams.SLOTS, bool)
    slots = [ngrams.present_with_repeats(t.encode(), seen) for t, _ in LABELLED]
    x = np.zeros((len(slots), ngrams.ALL_SLOTS))
    for r, s in zip(x, slots):
        r[s] = 1
    y = np.array([1.0 if q else -1.0 for _, q in LABELLED])
    p, q = 1 + x[y > 0].sum(axis=0), 1 + x[y < 0].sum(axis=0)
    ratio = np.log(p / ((y > 0).sum() + 2)) - np.log(q / ((y < 0).sum() + 2))
    f = x * ratio / np.sqrt(np.maximum(1, x.sum(axis=1)))[:, None]
    # the sample's order decides which rows are left out for the curve
    order = [r["doc_id"] for r in labels.orderBy(F.xxhash64(F.lit(3), "doc_id").bitwiseAND(F.lit((1 << 63) - 1)), "doc_id").collect()]
    fitted = [i for k, i in enumerate(order) if k % 5 != 4]
    g, t = np.c_[f[fitted], np.ones(len(fitted))], y[fitted]
    cost = np.array([len(y) / (2 * (y == v).sum()) for v in t])
    # minimum of |w|^2 / 2 + sum of cost * max(0, 1 - t g w)^2 in the span of the rows, by Newton steps
    a = np.zeros(len(g))
    gram = g @ g.T
    for _ in range(200):
        gap = 1 - t * (gram @ a)
        on = gap > 0
        a_new = np.zeros(len(g))
        a_new[on] = np.linalg.solve(gram[np.ix_(on, on)] + np.diag(0.5 / cost[on]), t[on])
        if np.allclose(a_new, a):
            break
        a = a_new
    w = g.T @ a
    want = f @ w[:-1] + w[-1]
    got = np.array([model.margin(s) for s in slots])
    assert np.abs(got - want).max() < 0.02 * np.abs(want).max()
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert all(abs(scores[i] - 1 / (1 + np.exp(-(model.slope * z + model.shift)))) < 1e-9 for i, z in enumerate(got))


def test_presence_is_exact_for_one_and_two_bytes():
    seen = np.zeros(ngrams.SLOTS, bool)
    slots = ngrams.present("AbÀ".encode(), True, seen)
    raw = b"ab\xc3\x80"
    want = {*raw, *((a << 8 | b) + 256 for a, b in zip(raw, raw[1:]))}
    assert {int(s) for s in slots if s < 256 + 65536} == want and not seen.any()
    assert list(ngrams.present(b"", True, seen)) == []


def test_folds_are_those_of_crc32(spark):
    import zlib

    ids = spark.range(50).select(F.col("id").alias("doc_id"), (F.crc32(F.col("id").cast("string").cast("binary")) % 5).alias("m")).collect()
    assert all(r["m"] == zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in ids)


def test_many_languages_share_the_landmarks():
    import time

    rng, seen = np.random.default_rng(3), np.zeros(ngrams.SLOTS, bool)
    count, each = 300, 20
    words = [["".join(chr(0x3400 + c * 40 + int(x)) for x in rng.integers(0, 40, 4)) for _ in range(30)] for c in range(count)]
    text = lambda c: " ".join(words[c][int(i)] for i in rng.integers(0, 30, 20))
    told = [(c, ngrams.present(text(c).encode(), True, seen)) for _ in range(each) for c in range(count)]
    began = time.time()
    model = language.train([r for _, r in told], [f"l{c:03}" for c, _ in told])
    assert time.time() - began < 60
    assert len(model.languages) == count and model.incidence.shape[1] == count * (language.LANDMARKS // count) and model.incidence.dtype == np.uint8
    fresh = [ngrams.present(text(c).encode(), True, seen) for c in range(count)]
    best = (model.kernel(*ngrams.batches_of(fresh)) @ model.weights).argmax(axis=1)
    assert np.mean([model.languages[b] == f"l{c:03}" for c, b in enumerate(best)]) > 0.95
    more = language._landmarks(np.array([f"x{i % 2000}" for i in range(5000)]), 1, 1024)
    assert len(more) == 1024 and len({i % 2000 for i in more}) == 1024


def test_kernel_is_the_same_in_any_pieces(monkeypatch):
    seen = np.zeros(ngrams.SLOTS, bool)
    rows = [ngrams.present(t.encode(), True, seen) for _, t in TEXTS]
    model = language.train(rows, [x for x, _ in TEXTS], per_language=2)
    some = ngrams.batches_of([rows[0], np.zeros(0, np.int64), *rows[1:], np.zeros(0, np.int64)])
    whole = model.kernel(*some)
    monkeypatch.setattr(language, "CELLS", 50)
    model.incidence = model.incidence.astype(np.uint8)
    assert (model.kernel(*some) == whole).all() and not whole[1].any() and not whole[-1].any()
