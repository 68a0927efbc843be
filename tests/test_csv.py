import pytest

from barloom.sources import csv


def lines(spark, text):
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line_no long, line string").where("trim(line) <> ''")


def days(n, start=0):
    import datetime as dt

    return [(dt.date(2020, 1, 1) + dt.timedelta(days=i + start)).isoformat() for i in range(n)]


def test_split_line():
    cases = {'a,b;c\td': ["a", "b", "c", "d"], '"1,234.5"; x ,""': ["1,234.5", "x", ""], '"a""b",c': ['a"b', "c"], "": [""]}
    for line, want in cases.items():
        assert csv.split_line(line) == want


def test_columns_split_alike(spark):
    some = ['a,b;c\td', '"1,234.5"; x ,""', '"a""b",c', "x,,y"]
    df = spark.createDataFrame([(s,) for s in some], "line string")
    got = {r["line"]: r["c"] for r in df.select("line", csv.cells_of(df["line"]).alias("c")).collect()}
    assert all(got[s] == csv.split_line(s) for s in some)


def test_headers():
    assert csv.find_header(["Date", "Adj Close", "Close"], csv.HEADERS["close"]) == 2
    assert csv.find_header(["my date", "x"], csv.HEADERS["date"]) == 0
    assert csv.find_header(["date", "volume", "close"], csv.HEADERS["low"]) == 1  # the one-letter fallback
    assert csv.find_header(["a"], csv.HEADERS["symbol"]) is None


def test_cleaning(spark):
    text = "date;ticker;open;high;low;close;volume\n2020-01-01;abcdefghijklmnop;;;;\"$1,234.50\";\n2020-01-02T10:00:00Z;;9;11;8;10;5%\nbad;x;1;1;1;1;1\n2020-01-03;x;1;1;1;zero;1\n2020-01-04;x;1;1;1;-2;1\n1/5/2020;x;3\n2020-01-06;x;3;4;2;3"
    df = lines(spark, text)
    cells = df.where("line_no > 0").select("line_no", csv.cells_of(df["line"]).alias("cells"))
    rows = csv.clean(cells, csv.split_line(text.split("\n")[0])).orderBy("line_no").collect()
    got = [(r["symbol"], str(r["date"]), r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in rows]
    assert got == [
        ("ABCDEFGHIJKL", "2020-01-01", 0, 0, 0, 1234.5, 0), ("IMPORT", "2020-01-02", 9, 11, 8, 10, 5), ("X", "2020-01-06", 3, 4, 2, 3, 0),
    ]


def universe(n_a, n_b):
    rows = [f"{d},a,{10 + i % 7}" for i, d in enumerate(days(n_a))] + [f"{d},b,{20 + i % 5}" for i, d in enumerate(days(n_b, 3))]
    return "\n".join(["date,symbol,close", *rows])


def test_report(spark):
    bars, report = csv.from_lines(lines(spark, universe(450, 430) + "\n2020-02-01,a,999\nnonsense"))
    assert report.symbols == ["A", "B"] and report.rows_read == 882 and report.rows_kept == 881 and len(report.warnings) == 1
    assert bars.count() == 2 * 430
    assert [r["close"] for r in bars.where("symbol = 'A' and date = '2020-02-01'").collect()] == [999]
    _, few = csv.from_lines(lines(spark, universe(360, 340)))
    assert any("340" in w for w in few.warnings)


def test_refusals(spark):
    for text in ("date,close\n2020-01-01,1", "date,price2x\nx\ny\nz", "day,close\n1,1\n2,2\n3,3", "date,close\nx,1\ny,2\nz,3", universe(200, 200)):
        with pytest.raises(csv.BadCsv):
            csv.from_lines(lines(spark, text.replace("price2x", "foo")))


def test_read_and_write(spark, tmp_path):
    from barloom.sources.csv import read_csv, write_bars

    (tmp_path / "u.csv").write_text(universe(420, 420))
    bars, _ = read_csv(spark, str(tmp_path / "u.csv"))
    write_bars(bars, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == bars.count() == 2 * 417
