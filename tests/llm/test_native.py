"""The operators without Python on the executors: URL filter, mixture, chat formatting."""

import hashlib
import json
import math
import random
from collections import Counter
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barloom.llm import chat, mixing, urls
from barloom.llm.queries import URL_RULES


def no_python(df):
    plan = df._jdf.queryExecution().toString()
    return not any(x in plan for x in ("Python", "Pandas", "InArrow"))


# --- URLs


def verdict(url, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host) :].split("?", 1)[0].split("#", 1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    short = host
    for x in ("www.", "m.", "blog."):
        if host.startswith(x):
            short = host[len(x) :]
            break
    tail = path[:-5] if path.endswith(".html") else path.rstrip("/")
    return host, path, None, "block" if short + tail and short + tail in listed else "allow"


URLS = [
    "http://A.Example.COM/en/7?x", "https://com/en/", "http://example.com/en/71", "http://x.example.com/en/8", "http://notexample.com/en/7", "http://a.net/de/", "http://example.net/de/80",
    "ftp://m.spam.org/x.html#t", "http://spam.org/x/", "http://spam.org/y", "nothing", "", None, "://", "http://", "http://a.org?/es/", "http://a.org/es/#", "a://b://c/d", "http://ÉX.com/en/\nz", "http://host:80/en/",
]


def test_urls(spark):
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS)] + [(None, URLS[7], "x", "y"), (3, URLS[3], "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, _maybe string")
    listed = spark.createDataFrame([("spam.org/x",), ("spam.org/x",), (None,), ("",), ("b:",)], "url_key string")
    out = urls.judge(pages, URL_RULES, listed)
    assert no_python(out)
    got = Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect())
    assert got == Counter((i, *verdict(u, {"spam.org/x", "b:"})) for i, u, _, _ in rows)
    assert urls.judge(pages.limit(0), URL_RULES, listed).count() == 0
    assert urls.judge(pages, URL_RULES, listed.limit(0)).where("verdict = 'block'").count() == sum(verdict(u, set())[3] == "block" for _, u, _, _ in rows)


def test_many_rules_are_joined_by_host(spark, monkeypatch):
    rng = random.Random(5)
    names = ["a", "b", "a.b", "b.a", "x.a.b", "", "c."]
    rules = [(rng.choice(["block", "allow"]), *pair) for pair in {(rng.choice(names), rng.choice(["/", "/p", "/p/q", ""])) for _ in range(60)}]
    pages = spark.createDataFrame([(i, f"http://{rng.choice(names)}{rng.choice(['', '.'])}{rng.choice(names)}{rng.choice(['/', '/p', '/p/q', '/z', ''])}") for i in range(300)] + [(900, None)], "page_id long, url string")
    listed = spark.createDataFrame([("a/p",)], "url_key string")
    want = Counter(tuple(r) for r in urls.judge(pages, rules, listed).collect())
    monkeypatch.setattr(urls, "COMPILED_RULES", 3)
    out = urls.judge(pages, rules, listed)
    assert no_python(out) and Counter(tuple(r) for r in out.collect()) == want
    monkeypatch.undo()
    many = [("block", f"h{i}", "/") for i in range(700)]
    assert urls.judge(spark.createDataFrame([(1, "http://x.h650/a"), (2, "http://h701/")], "page_id long, url string"), many, listed).where("rule = 'h650/'").count() == 1


def test_canonical(spark):
    cases = {"/a.html": "/a", "/a///": "/a", "/": "", ".html": "", "/a.html/": "/a.html", "/" * 200_000 + "x": "/" * 200_000 + "x", "/a/\n": "/a/\n", "": ""}
    df = spark.createDataFrame([("m.h", p) for p in cases], "h string, p string")
    assert [r[0] for r in df.select(urls.canonical(F.col("h"), F.col("p"))).collect()] == ["h" + c for c in cases.values()]


def test_bloom_lets_listed_pass_and_few_others(spark):
    listed = spark.range(3000).select(F.concat(F.lit("site/"), F.col("id").cast("string")).alias("url_key"))
    other = spark.range(3000, 13000).select(F.concat(F.lit("site/"), F.col("id").cast("string")).alias("url_key"))
    assert urls.possible(listed, listed).where("not _maybe").count() == 0
    assert urls.possible(other, listed).where("_maybe").count() < 1000


# --- mixture


@pytest.mark.parametrize("weights", [[1, 1], [1, 2, 3], [5, 1, 1, 7], [1, 9], [3], [2, 2, 2, 1, 1, 13]])
def test_frame_stays_within_a_block(weights):
    places = mixing.frame(weights)
    total = sum(weights)
    order = {p: s for s, ps in enumerate(places) for p in ps}
    assert sorted(order) == list(range(total)) and [len(p) for p in places] == weights
    done = [0] * len(weights)
    for t in range(total):
        done[order[t]] += 1
        for s, w in enumerate(weights):
            assert abs(done[s] - Fraction(w * (t + 1), total)) < 1


def naive_frame(weights):
    """Earliest due first, by looking at every source at every place."""
    n, taken, out = sum(weights), [0] * len(weights), [[] for _ in weights]
    for t in range(n):
        open_ = [(math.ceil(Fraction((taken[s] + 1) * n, w)), s) for s, w in enumerate(weights) if taken[s] < w and math.floor(Fraction(taken[s] * n, w)) <= t]
        s = min(open_)[1]
        out[s].append(t)
        taken[s] += 1
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=12))
def test_frame_is_earliest_due_first(weights):
    assert mixing.frame(weights) == naive_frame(weights)


def test_phases_place_every_block_once():
    rng = random.Random(3)
    for _ in range(40):
        blocks = {s: rng.randint(0, 30) for s in "abcde"}
        weights = {s: rng.randint(1, 5) for s in "abcde"}
        slots = {}
        for s, first, end, at, frame, w, places in mixing._plan([x for x in "abcde"], weights, blocks):
            for b in range(first, end):
                slots[s, b] = at + (b - first) // w * frame + places[(b - first) % w]
        assert set(slots) == {(s, b) for s, n in blocks.items() for b in range(n)} and len(set(slots.values())) == len(slots)
        # brute force: frames of the sources that are left, as long as all of them fill one, or one frame if some can't
        left, at, want = dict(blocks), 0, {}
        while any(left.values()):
            active = [s for s in "abcde" if left[s]]
            whole = max(1, min(left[s] // weights[s] for s in active))
            for _ in range(whole):
                for s, places in zip(active, naive_frame([weights[s] for s in active])):
                    for p in places[: left[s]]:
                        want[s, blocks[s] - left[s]] = at + p
                        left[s] -= 1
                at += sum(weights[s] for s in active)
        assert slots == want


def test_many_sources_and_places(spark, monkeypatch):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 1500).cast("string")).alias("source"))
    weights = {f"s{k}": 1 + k % 40 for k in range(1500)}
    assert sum(weights.values()) > 20_000
    out = mixing.mix(df, weights, block_rows=1)
    assert no_python(out)
    got = {(r["doc_id"], r["position"]) for r in out.collect()}
    assert len(got) == 3000 and len({p for _, p in got}) == 3000
    monkeypatch.setattr(mixing, "BROADCAST_PLACES", 10)
    assert {(r["doc_id"], r["position"]) for r in mixing.mix(df, weights, block_rows=1).collect()} == got


def test_mix_leaves_columns_of_any_name(spark):
    names = ("_n", "_bucket", "_w", "_at", "n", "own", "s", "first", "end", "at", "frame", "w", "places", "whole", "bucket", "before", "within", "b", "c", "a.b")
    df = spark.createDataFrame([(i, "ab"[i % 2], *(f"{x}{i}" for x in names)) for i in range(40)], "doc_id long, source string, " + ", ".join(f"`{x}` string" for x in names))
    out = mixing.mix(df, block_rows=4)
    assert out.columns == [*df.columns, "block", "slot", "position"]
    rows = out.collect()
    assert len(rows) == 40 and all(tuple(r)[2:-3] == tuple(f"{x}{r['doc_id']}" for x in names) for r in rows)


def test_rows_without_an_id_are_dealt_out(spark):
    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.col("id").alias("text"))
    rows = mixing._columns(df, df.columns)
    assert rows.count() == 4000
    out = mixing.mix(df, block_rows=4, bucket_rows=100).collect()
    assert sorted(r["position"] for r in out) == list(range(4000)) and len({r["text"] for r in out}) == 4000


def test_mix(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a"] * 6 + ["b", "c", None])) for i in range(900)] + [(5, "a"), (None, "b"), (None, "b")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, Slot string").repartition(5)
    weights = {"a": 3, "b": 2, "c": 1}
    out = mixing.mix(df, weights, block_rows=4, bucket_rows=50)
    assert no_python(out) and out.columns == ["doc_id", "source", "block", "slot", "position"]
    got = out.collect()
    assert Counter((r["doc_id"], r["source"]) for r in got) == Counter(rows)
    assert len({r["position"] for r in got}) == len(rows)
    sizes = Counter((r["source"], r["block"]) for r in got)
    n = Counter(s for _, s in rows)
    assert all(v == 4 or b == n[s] // 4 for (s, b), v in sizes.items())
    slot_of = {r["slot"]: r["source"] for r in got}
    assert len(slot_of) == len(sizes)
    # while all sources last, each is within a block of its share
    parts = {"a": 3, "b": 2, "c": 1, None: 1}
    frames = min(-(-n[s] // 4) // w for s, w in parts.items())
    done = Counter()
    for t in range(frames * 7):
        done[slot_of[t]] += 1
        assert all(abs(done[s] - Fraction(w * (t + 1), 7)) < 1 for s, w in parts.items())
    again = mixing.mix(df.repartition(2), weights, block_rows=4, bucket_rows=50)
    assert Counter((r["source"], r["block"], r["slot"]) for r in again.collect()) == Counter((r["source"], r["block"], r["slot"]) for r in got)
    assert mixing.mix(df.limit(0), weights).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(df, {"a": 0})


# --- chats

NASTY = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<\\s>", "[ROLE x]] [/ROLE]", " ", "", "a\n\n[INST]b", "<<s>", "[/INST", " [/INST]", "é\u2028\U0001f600", "[[INST]] $1 \\2"]


def round_trip(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, record string, _pieces string")
    out = chat.render(chat.to_turns(chat.records_of_rows(df)))
    assert no_python(out)
    back = out.select("conv_id", "layout", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), "formatted", "loss_spans")
    return {r["conv_id"]: r for r in back.collect()}


def test_round_trip(spark):
    rng = random.Random(7)
    roles = ["user", "assistant", "system", "tool", "", "x] [/ROLE]", "as\\sistant"]
    rows, want = [], {}
    for c in range(150):
        turns = [(t, rng.choice(roles), "".join(rng.choice(NASTY) for _ in range(rng.randint(0, 4)))) for t in range(rng.randint(1, 6))]
        want[c] = [(r, x) for _, r, x in turns]
        rows += [(c, t, r, x, "z", "z") for t, r, x in turns]
    rng.shuffle(rows)
    got = round_trip(spark, rows)
    for c, turns in want.items():
        assert [tuple(t) for t in got[c]["turns"]] == turns
        assert got[c]["loss"] == "".join(x for r, x in turns if r == "assistant")
        assert got[c]["layout"] == "messages(role,content)"
        for s, (r, x) in zip(got[c]["loss_spans"], [t for t in turns if t[0] == "assistant"]):
            assert 0 <= s["start"] <= s["end"] <= len(got[c]["formatted"])


def test_chat_edges(spark):
    rows = [(1, 0, None, None), (1, None, "user", "first"), (2, 0, "user", "a"), (2, 0, "user", "a"), (2, 0, "assistant", "b"), (None, 0, "user", "n")]
    got = round_trip(spark, [(*r, "z", "z") for r in rows])
    assert [tuple(t) for t in got[1]["turns"]] == [("user", "first"), ("", "")]
    assert [tuple(t) for t in got[2]["turns"]] == [("assistant", "b"), ("user", "a"), ("user", "a")]
    assert [tuple(t) for t in got[None]["turns"]] == [("user", "n")]
    assert round_trip(spark, [(*rows[0], "z", "z")][:0]) == {}


def test_layouts(spark):
    u, a = ("user", "q"), ("assistant", "r")
    cases = [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "r"}]}, [u, a]),
        ({"id": 3, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]}, [u, a]),
        ({"system": "s", "conversations": [{"from": "human", "value": "q"}]}, [("system", "s"), u]),
        ({"instruction": "q", "input": "", "output": "r"}, [u, a]),
        ({"instruction": "q", "input": "more", "output": "r"}, [("user", "q\n\nmore"), a]),
        ({"prompt": "q", "completion": "r"}, [u, a]),
        ({"prompt": "q", "response": "r", "id": "x"}, [u, a]),
        ({"question": "q", "answer": "r"}, [u, a]),
        ({"dialog": [{"speaker": "human", "text": "q"}, {"speaker": "bot", "text": "r"}]}, [u, a]),
        ({"messages": []}, []),
        ({"messages": [{"role": "user"}, {"content": "q"}]}, [("user", ""), ("", "q")]),
        ({"foo": 1}, None),
    ]
    rows = [(i, json.dumps(r)) for i, (r, _) in enumerate(cases)] + [(90, "not json"), (91, None)]
    out = {r["id"]: r for r in chat.to_turns(spark.createDataFrame(rows, "id int, record string")).collect()}
    for i, (_, want) in enumerate(cases):
        got = out[i]["turns"]
        assert (got if got is None else [tuple(t) for t in got]) == want, cases[i]
    assert out[90]["turns"] is None and out[91]["turns"] is None
    prints = Counter(chat.fingerprint_of(p) for m in chat.MAPPINGS for p in m.paths)
    assert max(prints.values()) == 1


def test_query_plus_one(spark, tmp_path):
    from barloom.llm.queries import op8_chat_format

    spark.createDataFrame([(4, 0, "user", None), (4, 1, "assistant", "é")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in op8_chat_format(spark, str(tmp_path)).collect()}
    said = "</s>[INST] ok [/INST]"
    assert set(got) == {4, -7} and got[4]["loss_chars"] == 1
    assert got[-7]["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert got[-7]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest() and got[-7]["loss_chars"] == len(said)
