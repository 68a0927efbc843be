from pyspark.sql import functions as F

from barloom.functions import formats
from barloom.operators import genome as G
from barloom.operators import views
from barloom.sources.genomes import fixed


def test_downsample_and_resample(spark):
    rows = spark.range(1000).select(F.lit("x").alias("s"), F.col("id").cast("int").alias("i"), F.col("id").alias("v"))
    got = {r["k"]: r["i"] for r in views.downsampled(rows, "s", 420).collect()}
    assert got == {k: k * 1000 // 420 for k in range(420)}
    assert views.downsampled(rows.where("i < 100"), "s", 420).count() == 100
    near = {r["k"]: r["v"] for r in views.resampled(rows.select("i", "v"), 7).collect()}
    assert near == {k: int(k / 6 * 999 + 0.5) for k in range(7)}


def test_leaderboard(spark):
    rows = spark.createDataFrame([("a", "trend", 0, 1, 0.5), ("b", "carry", 1, 2, -0.1), ("c", "trend", 1, 3, 0.2)], "genome_id string, family string, cluster int, rank int, sharpe double")
    names = lambda **k: [r["genome_id"] for r in views.leaderboard(rows, **k).collect()]
    assert names() == ["a", "b", "c"] and names(positive=True, sort="sharpe") == ["a", "c"] and names(family="trend", cluster=1) == ["c"]


def test_formats(spark):
    row = spark.createDataFrame([(0.1234, -1.5, float("nan"), 1234567.0, 61500.0)], "a double, b double, n double, big double, ms double")
    got = row.select(
        formats.pct(F.col("a")), formats.signed_pct(F.col("a")), formats.signed(F.col("b")), formats.num(F.col("n")), formats.compact(F.col("big")), formats.integer(F.col("big")),
        formats.duration(F.col("ms")), formats.duration(F.lit(250.0)), formats.title_case(F.lit("meanReversion")), formats.short_date(F.lit("2024-03-05").cast("date")), formats.month_label(F.lit("2024-03-05").cast("date")),
    ).first()
    assert list(got) == ["12.3%", "+12.3%", "-1.50", "–", "1.2M", "1,234,567", "1m 2s", "250ms", "Mean Reversion", "05/03/24", "Mar 2024"]


def test_names(spark):
    g = fixed(spark)
    got = {r["genome_id"]: (r["n"], r["d"]) for r in g.select("genome_id", G.name_column(g).alias("n"), G.describe_column().alias("d")).collect()}
    assert got["g01"][0] == "Trend.A.20-100" and got["g05"][0] == "MeanReversion.R.30-1.20"
    assert "Stop at 2.5 ATR." in got["g02"][1] and "Long only." in got["g02"][1]


def test_extents(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 3.0), ("b", 2.0), ("c", float("inf"))], "k string, v double")
    got = {r["k"]: (r["low"], r["high"]) for r in views.extents(rows, "k", "v").collect()}
    assert got == {"a": (1, 3), "b": (1, 3), "c": (None, None)}
