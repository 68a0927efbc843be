"""What Python workers hold: shards closed within a batch, and memory given back when a task ends."""

import re
from pathlib import Path

import pyarrow as pa
import pytest

from barloom.llm import common, decontaminate


def run_of(monkeypatch, docs, benchmark, shard_words):
    """What without_leaks runs on the workers, with the documents that it keeps."""
    kept = []

    class Docs:
        schema = docs.schema

        class sparkSession:
            class sparkContext:
                @staticmethod
                def broadcast(x):
                    return type("Sent", (), {"value": x})

        def mapInArrow(self, run, schema):
            for out in run(iter(docs.to_batches())):
                kept.extend(out.column("doc_id").to_pylist())

    monkeypatch.setattr(decontaminate, "prepare", lambda spark: None)
    monkeypatch.setattr(decontaminate, "_many", lambda *_: False)
    monkeypatch.setattr(decontaminate, "_blocks", lambda *_: iter([decontaminate.Phrases(benchmark, 3)]))
    decontaminate.without_leaks(Docs(), None, window=3, shard_words=shard_words)
    return kept


def test_leaks_are_looked_for_in_shards_within_a_batch(monkeypatch):
    texts = [None if i == 5 else "" if i == 6 else f"w{i} x y z{i} " * 20 + ("A b-C é" if i % 7 == 0 else "b c a") for i in range(200)]
    docs = pa.table({"doc_id": pa.array(range(200)), "text": pa.array(texts, pa.string())})
    sizes, hits = [], decontaminate.shard_hits
    monkeypatch.setattr(decontaminate, "shard_hits", lambda rows, phrases: sizes.append(sum(map(len, rows))) or hits(rows, phrases))
    monkeypatch.setattr(decontaminate, "PIECE", 2000)
    assert run_of(monkeypatch, docs, [(1, b"a B c")], 500) == [i for i in range(200) if i % 7]
    assert len(sizes) > 10 and max(sizes) < 1500


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory can't be read")
def test_a_task_gives_its_memory_back():
    def mb():
        return int(re.search(r"Pss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024

    last = []

    def run(batches):
        many = [bytearray(60_000) for _ in range(3000)]
        last.append(bytearray(60_000))  # lies above the others, which would else stay with the process
        yield from batches
        del many

    before = mb()
    assert list(common.released(run)(iter([1, 2]))) == [1, 2]
    assert mb() - before < 40
