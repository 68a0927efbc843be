"""The pipeline against a brute-force version of every stage, each on what its predecessor kept."""

import os
from collections import Counter

import numpy as np
import pandas as pd

import corpus_pipeline
from barloom.llm import language, lines, ngrams
from barloom.llm.common import shared_dir
from barloom.llm.queries import source_weights
from test_decontaminate import brute as leaks
from test_minhash import brute as near
from test_native import naive_frame

SF = "/root/testdata/sf0.001"


def language_by_hand(before, model):
    """Ids of texts that a learned language claims: kernels by sets, the winner's lead and the map's norm."""
    known = np.full(len(model.column), -1)
    slots = np.flatnonzero(model.column < len(model.incidence) - 1)
    known[model.column[slots]] = slots
    marks = [set(known[np.flatnonzero(model.incidence[:-1, k])].tolist()) for k in range(model.incidence.shape[1])]
    seen, stay = np.zeros(ngrams.SLOTS, bool), set()
    for i, text in zip(before["doc_id"], before["text"]):
        if not text or not any(c.isalpha() for c in text):
            continue
        own = set(ngrams.present(text.encode(), True, seen).tolist())
        k = np.array([len(own & m) / np.sqrt(len(own) * len(m)) for m in marks])
        f = np.sort(k @ model.weights)
        norm, lead = np.linalg.norm(k @ model.root), f[-1] - f[-2]
        if (f[-1] + 1) / 2 >= 0.25 and norm >= language.LEAST_KNOWN and (norm >= language.WELL_KNOWN or lead >= language.LEAST_LEAD or len(text) < language.SHORT):
            stay.add(i)
    return stay


def lines_by_hand(before):
    """{doc_id: text} without lines that are not the first of their class."""
    seen = [(d, n, x) for d, t in zip(before["doc_id"], before["text"]) for n, x in enumerate((t or "").split("\n")) if x.strip()]
    kinds = sorted({x for _, _, x in seen}, key=len)
    top = {x: x for x in kinds}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(kinds):
        few = min(2, len(a) * 2 // 40)
        for b in kinds[i + 1 :]:
            if len(b) - len(a) > few:
                break
            if few and lines.within(a, b, few):
                top[find(b)] = find(a)
    first = {}
    for d, n, x in seen:
        first[find(x)] = min(first.get(find(x), (d, n)), (d, n))
    gone = {(d, n) for d, n, x in seen if (d, n) != first[find(x)]}
    out = {}
    for d, t in zip(before["doc_id"], before["text"]):
        parts = (t or "").split("\n")
        rest = "\n".join(x for n, x in enumerate(parts) if (d, n) not in gone)
        if rest.strip() or rest == (t or ""):
            out[d] = rest
    return out


def test_every_stage(spark, monkeypatch):
    seen, models = {}, []
    fit = language.fit
    monkeypatch.setattr(language, "fit", lambda docs: models.append(fit(docs)) or models[-1])

    def watched(name, stage):
        def run(spark, docs, sf_dir):
            out = stage(spark, docs, sf_dir)
            seen[name] = (docs.toPandas(), out.toPandas(), out.columns)
            return out

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, watched(n, f)) for n, f in corpus_pipeline.STAGES])
    shared = shared_dir(spark).removeprefix("file://")
    there = set(os.listdir(shared))
    last = corpus_pipeline.run(spark, SF).toPandas()
    assert [x.split("-")[1] for x in set(os.listdir(shared)) - there] == ["decontamination"]  # what the result reads
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    assert docs["doc_id"].is_unique and list(seen) == ["language_id", "line_dedup", "minhash_dedup", "decontamination", "mixing"]
    assert all(list(seen[n][2]) == list(docs.columns) for n in list(seen)[:-1])

    before, after, _ = seen["language_id"]
    assert set(after["doc_id"]) == language_by_hand(before, models[0])
    before, after, _ = seen["line_dedup"]
    assert dict(zip(after["doc_id"], after["text"])) == lines_by_hand(before)
    assert (after["n_chars"] == after["text"].str.len()).all()
    before, after, _ = seen["minhash_dedup"]
    top, _ = near(list(zip(before["doc_id"], before["text"])), 5, 80)
    assert set(after["doc_id"]) == {i for i, t in top.items() if i == t}
    before, after, _ = seen["decontamination"]
    items = list(pd.read_parquet(f"{SF}/benchmark.parquet")[["item_id", "text"]].itertuples(index=False, name=None))
    assert set(after["doc_id"]) == {i for i, t in zip(before["doc_id"], before["text"]) if not leaks(t, items, 10)[1]}
    before, after, _ = seen["mixing"]
    assert sorted(last["doc_id"]) == sorted(before["doc_id"]) and last["position"].is_unique
    # blocks of 16 by source, placed by earliest due first in frames of the sources that are left
    names = sorted(before["source"].unique())
    left, at, want = {s: -(-n // 16) for s, n in Counter(before["source"]).items()}, 0, {}
    total = dict(left)
    while any(left.values()):
        active = [s for s in names if left[s]]
        weights = [source_weights().get(s, 1) for s in active]
        for _ in range(max(1, min(left[s] // w for s, w in zip(active, weights)))):
            for s, places in zip(active, naive_frame(weights)):
                for p in places[: left[s]]:
                    want[s, total[s] - left[s]] = at + p
                    left[s] -= 1
            at += sum(weights)
    assert {(s, b): slot for s, b, slot in last[["source", "block", "slot"]].itertuples(index=False, name=None)} == want
