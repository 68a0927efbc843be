"""Stateful streams against batch results, with late rows and a restart."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.streaming.online import Rule, batch_trades, online_trades
from barloom.streaming.sessions import sessions, sessions_and_late

DAY = datetime(2024, 1, 1)


@pytest.fixture
def stateful(spark):
    """State of the kind that transformWithState needs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def written(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path))


def run(spark, make, schema, root, name, rounds):
    """Feeds one folder a trigger; each round is a query of its own that goes on from the checkpoint."""
    for k, files in enumerate(rounds):
        for j, rows in enumerate(files):
            written(spark, rows, schema, root / f"in/{k:02}{j:02}")
            stream = spark.readStream.schema(schema).parquet(f"{root}/in/*")
            q = make(stream).writeStream.format("parquet").option("path", str(root / "out")).option("checkpointLocation", str(root / "cp")).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination(180)
            assert q.exception() is None
    return spark.read.parquet(str(root / "out"))


SCHEMA = "user_id long, ts timestamp, value double"


def test_sessions_and_late_rows(stateful, tmp_path):
    at = lambda m: DAY + timedelta(minutes=m)
    first = [(1, at(0), 1.0), (1, at(20), 2.0), (2, at(5), 4.0), (1, at(100), 8.0), (3, None, 1.0)]
    second = [(2, at(30), 16.0), (1, at(95), 32.0), (2, at(400), 1.0)]
    late = [(1, at(10), 64.0), (2, at(399), 128.0), (2, at(900), 1.0)]
    tail = [(9, at(5000), 1.0)]
    got = run(stateful, lambda s: sessions_and_late(s, "30 minutes", "60 minutes"), SCHEMA, tmp_path, "s", [[first, second], [late, tail], [[(9, at(9000), 1.0)]]])
    rows = sorted((r["user_id"], r["kind"], round((r["started"] - DAY).total_seconds() / 60), round((r["ended"] - DAY).total_seconds() / 60), r["events"], r["total"]) for r in got.collect())
    assert rows == [
        (1, "late", 10, 40, 1, 64.0), (1, "session", 0, 50, 2, 3.0), (1, "session", 95, 130, 2, 40.0), (2, "late", 30, 60, 1, 16.0), (2, "session", 5, 35, 1, 4.0),
        (2, "session", 399, 430, 2, 129.0), (2, "session", 900, 930, 1, 1.0), (9, "session", 5000, 5030, 1, 1.0),
    ]


def test_batch_sessions(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    got = sessions(events, "2 hours")
    rows, want = sorted((r["user_id"], r["ts"]) for r in events.collect()), []
    for u, t in rows:
        if want and want[-1][0] == u and t < want[-1][2] + timedelta(hours=2):
            want[-1] = (u, want[-1][1], t, want[-1][3] + 1)
        else:
            want.append((u, t, t, 1))
    assert sorted((r["user_id"], r["started"], r["events"]) for r in got.collect()) == sorted((u, a, n) for u, a, _, n in want)


BARS = "symbol string, ts timestamp, high double, low double, close double"


def some_bars(symbol, n, seed):
    rng = np.random.default_rng(seed)
    hours = np.cumsum(rng.choice([1, 1, 1, 1, 9], n))
    close = 100 + np.cumsum(rng.standard_normal(n))
    return [(symbol, DAY + timedelta(hours=int(h)), float(c + a), float(c - b), float(c)) for h, c, a, b in zip(hours, close, rng.random(n), rng.random(n))]


def plain_trades(rows, rule):
    """Bar by bar over lists."""
    out = []
    for symbol in sorted({r[0] for r in rows}):
        bars, side, opened = sorted(r for r in rows if r[0] == symbol), 0, None
        for i, (_, ts, _, _, close) in enumerate(bars):
            h, low = [b[2] for b in bars[:i]], [b[3] for b in bars[:i]]
            if side and ts - bars[i - 1][1] > timedelta(microseconds=rule.idle_us):
                out.append((symbol, side, opened[0], bars[i - 1][1] + timedelta(microseconds=rule.idle_us), opened[1], bars[i - 1][4], "expired"))
                side = 0
            if side and i >= rule.leave and (close < min(low[-rule.leave :]) if side > 0 else close > max(h[-rule.leave :])):
                out.append((symbol, side, opened[0], ts, opened[1], close, "signal"))
                side = 0
            if not side and i >= rule.entry:
                side = 1 if close > max(h[-rule.entry :]) else -1 if close < min(low[-rule.entry :]) else 0
                opened = (ts, close)
    return sorted(out)


def test_online_ledger(stateful, tmp_path):
    rule = Rule(entry=5, leave=3, idle_us=6 * 3_600_000_000)
    rows = sorted(some_bars("A", 160, 1) + some_bars("B", 90, 2) + some_bars("C", 4, 3), key=lambda r: r[1])
    want = plain_trades(rows, rule)
    ledger = lambda df: sorted(tuple(r) for r in df.collect())
    assert len({r[-1] for r in want}) == 2 and len(want) > 20
    assert ledger(batch_trades(stateful.createDataFrame(rows, BARS), rule)) == want
    end = [("Z", rows[-1][1] + timedelta(days=9), 1.0, 1.0, 1.0)]
    cut = [rows[:60], rows[60:130], rows[130:]]
    got = ledger(run(stateful, lambda s: online_trades(s, rule), BARS, tmp_path, "o", [[cut[0]], [cut[1], cut[2]], [end], [end]]))
    still = [t for t in got if t not in want]  # sides that were open at the end expire by their timers
    assert [t for t in got if t in want] == want
    assert all(t[-1] == "expired" for t in still) and len(still) <= 3


def test_events_as_bars(spark):
    from barloom.streaming.bars import stream_bars

    bars = stream_bars(spark.read.parquet("/root/testdata/sf0.001/events.parquet"), "3 hours")
    got = batch_trades(bars, Rule(8, 4))
    rows = [(r["symbol"], r["ts"], r["high"], r["low"], r["close"]) for r in bars.collect()]
    assert sorted(tuple(r) for r in got.collect()) == plain_trades(rows, Rule(8, 4))
    assert got.where(F.col("closed") <= F.col("opened")).count() == 0
