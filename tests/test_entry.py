"""The driver's contract, and some twins; BARLOOM_TWINS=all compares every twin."""

import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from barloom.plans import oracle, queries

ROOT = Path(__file__).resolve().parents[1]
SF = os.environ.get("TWIN_DIR", "/root/testdata/sf0.01")
SOME = ("flagship", "asof_join", "interval_join", "symbol_regime_shares", "symbol_regime_path", "kmeans_rounds", "greedy_apart", "signal_function", "ohlcv_files", "event_sessions", "channel_trades", "sliding_extremes", "sliding_percentile", "benchmark_tail", "bars_weekly", "csv_clean_rows", "vol_percentile", "rsi", "signal_carry", "backtest_trades", "metrics_is_oos", "regime_segments", "genome_repair", "silhouette")
CHOSEN = sorted(oracle.oracle_sql()) if os.environ.get("BARLOOM_TWINS") == "all" else SOME


def rows_of(frame):
    cols = sorted(frame.columns)
    text = lambda v: "~" if v is None or (isinstance(v, float) and math.isnan(v)) else str(v).removesuffix(" 00:00:00")
    return sorted(tuple(text(v) for v in r) for r in frame[cols].itertuples(index=False)), cols


@pytest.mark.parametrize("name", CHOSEN)
def test_twin(spark, name):
    db = duckdb.connect()
    for t in ("lineitem", "orders", "events", "documents", "embeddings"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = db.execute(oracle.oracle_sql()[name]).fetchdf()
    got = queries.queries()[name](spark, SF).toPandas()
    assert rows_of(got) == rows_of(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 3


def test_twins_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_imports_the_optional_package():
    for p in (ROOT / "barloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "barloom").parts:
            assert "llm" not in p.read_text(), p


def test_entry_works_without_it(tmp_path):
    (tmp_path / "barloom").mkdir()
    for p in (ROOT / "barloom").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "barloom" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship' in q and 'pipeline' not in q and not [n for n in q if n.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": ""}, check=True, timeout=60)
