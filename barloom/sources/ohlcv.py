"""format("ohlcv"): price CSVs as a Spark data source with matched headers, split files, pushed filters and committed writes.

Reading: `path` is a file or a folder. Each file's own header is matched by name, so files may differ; values are
cleaned as csv.clean does. Files are cut at line ends into pieces of `pieceBytes`, each a task. Filters on
symbol and date are taken over whole: of a folder that this source wrote, files of other symbols aren't opened, other rows are left out as they are
read. That is so if spark.sql.python.filterPushdown.enabled is set when the source is registered, as barloom.session does;
without it Spark refuses readers that take filters, and looks at all rows itself.

Writing: tasks write to a staging folder under names of their own. A commit moves their files in place and then puts a new
list of the table's files under its final name, in one step; readers follow the latest list, so they see a whole write or nothing of it.
A failed or repeated task leaves only files that no list names.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.types import Row, StructType

from .csv import HEADERS, BadCsv, find_header, split_line

SCHEMA = "symbol string, date date, open double, high double, low double, close double, volume double"
FIELDS = ("open", "high", "low", "close", "volume")
PIECE, ROWS, OPEN_FILES = 32 << 20, 8192, 64
# Notations of a day besides ISO.
DAYS = ("%m/%d/%Y", "%Y/%m/%d", "%d %b %Y", "%b %d, %Y", "%b %d %Y", "%Y-%m-%d")
_ARROW = pa.schema([("symbol", pa.string()), ("date", pa.date32()), *((f, pa.float64()) for f in FIELDS)])


def register(spark: SparkSession) -> None:
    """Registers the source in the form that the session's filterPushdown allows; call it again when that changes."""
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower() == "true"
    spark.dataSource.register(Ohlcv if pushed else Unpushed)


def number(cell: str | None) -> float | None:
    """Money, percent and thousands signs dropped; blank is 0, unreadable None."""
    if cell is None:
        return None
    bare = re.sub(r"[$,%\s]", "", cell)
    try:
        return float(bare) if bare else 0.0
    except ValueError:
        return None


def day(cell: str | None) -> dt.date | None:
    if not cell:
        return None
    if re.match(r"\d{4}-\d{2}-\d{2}", cell):
        try:
            return dt.date.fromisoformat(cell[:10])
        except ValueError:
            pass
    for form in DAYS:
        try:
            return dt.datetime.strptime(cell, form).date()
        except ValueError:
            continue
    return None


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _latest(fs: pafs.FileSystem, root: str) -> tuple[int, list[str]] | None:
    """Number and files of the table's last committed list; None for a folder that this source didn't write."""
    info = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    lists = sorted(int(m[1]) for f in info if (m := re.match(r"_files-(\d+)\.json$", f.base_name)))
    if not lists:
        return None
    with fs.open_input_stream(f"{root}/_files-{lists[-1]}.json") as f:
        return lists[-1], json.loads(f.read())


@dataclass
class Piece(D.InputPartition):
    path: str
    symbol: str | None
    columns: dict[str, int]
    start: int
    end: int


class Ohlcv(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "ohlcv"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return PushedReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        missing = {"symbol", "date", "close"} - set(schema.names)
        if missing:
            raise BadCsv(f"no column {', '.join(sorted(missing))}")
        return Writer(self.options["path"], overwrite)


class Unpushed(Ohlcv):
    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options)


class Reader(D.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.piece = options["path"], int(options.get("pieceBytes", PIECE))
        self.symbols: set[str] | None = None
        self.first, self.last = dt.date.min, dt.date.max

    def partitions(self) -> list[D.InputPartition]:
        fs, root = _at(self.path)
        alone = fs.get_file_info(root).type == pafs.FileType.File
        listed = None if alone else _latest(fs, root)
        if alone:
            files = [root]
        elif listed:
            files = [f"{root}/{name}" for name in listed[1]]
        else:
            found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
            files = sorted(f.path for f in found if f.type == pafs.FileType.File and not re.search(r"/[_.]", f.path[len(root) :]))
        out = []
        for path in files:
            folder = re.search(r"/symbol=([^/]*)/[^/]*$", path)
            symbol = unquote(folder[1]) if folder else None
            if symbol is not None and self.symbols is not None and symbol not in self.symbols:
                continue
            header, begin, size = self._header(fs, path)
            at = {k: find_header(header, v) for k, v in HEADERS.items()}
            if at["date"] is None or at["close"] is None:
                raise BadCsv(f"{path}: a date and a close column are needed")
            columns = {k: i for k, i in at.items() if i is not None}
            out += [Piece(path, symbol, columns, lo, min(lo + self.piece, size)) for lo in range(begin, size, self.piece)]
        return out or [Piece("", None, {}, 0, 0)]

    @staticmethod
    def _header(fs: pafs.FileSystem, path: str) -> tuple[list[str], int, int]:
        """(header, where the rows begin, size of the file)."""
        with fs.open_input_file(path) as f:
            head = b""
            while b"\n" not in head and (more := f.read(1 << 16)):
                head += more
            line = head.split(b"\n", 1)[0]
            return split_line(line.decode("utf-8-sig", "replace").strip("\r")), len(line) + 1, f.size()

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for line in self._lines(piece):
            row = self._row(piece, split_line(line))
            if row is not None:
                rows.append(row)
            if len(rows) >= ROWS:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _lines(piece: Piece) -> Iterator[str]:
        """The lines that begin in the piece; the first one belongs to the piece before if it began there."""
        if not piece.path:
            return
        fs, _ = _at(piece.path)
        with fs.open_input_file(piece.path) as f:
            f.seek(piece.start - 1)  # the header lies before every piece
            data = f.read(piece.end - piece.start + 1)
            while not data.endswith(b"\n") and (more := f.read(1 << 16)):
                cut = more.find(b"\n")
                data += more if cut < 0 else more[: cut + 1]
        if data[:1] != b"\n":
            data = data.partition(b"\n")[2] if b"\n" in data else b""
        for line in data.split(b"\n"):
            text = line.decode("utf-8", "replace").strip()
            if text:
                yield text

    def _row(self, piece: Piece, cells: list[str]) -> tuple | None:
        cell = lambda k: cells[piece.columns[k]] if k in piece.columns and piece.columns[k] < len(cells) else None
        date, close = day(cell("date")), number(cell("close"))
        if date is None or close is None or not 0 < close < float("inf") or not self.first <= date <= self.last:
            return None
        symbol = piece.symbol if piece.symbol is not None else (cell("symbol") or "IMPORT").upper()[:12]
        if self.symbols is not None and symbol not in self.symbols:
            return None
        opened, high, low, volume = (number(cell(k)) for k in ("open", "high", "low", "volume"))
        opened = close if opened is None else opened
        return symbol, date, opened, max(close, opened) if high is None else high, min(close, opened) if low is None else low, close, volume or 0.0

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


class PushedReader(Reader):
    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        """Takes equality and lists of symbols and all bounds of dates; what it takes needs no second look."""
        for f in filters:
            column, value = getattr(f, "attribute", ()), getattr(f, "value", None)
            if column == ("symbol",) and isinstance(f, D.EqualTo | D.In):
                some = {value} if isinstance(f, D.EqualTo) else set(value)
                self.symbols = some if self.symbols is None else self.symbols & some
            elif column == ("date",) and isinstance(f, D.EqualTo | D.GreaterThan | D.GreaterThanOrEqual | D.LessThan | D.LessThanOrEqual):
                one = dt.timedelta(days=1)
                if isinstance(f, D.GreaterThan | D.GreaterThanOrEqual | D.EqualTo):
                    self.first = max(self.first, value + one if isinstance(f, D.GreaterThan) else value)
                if isinstance(f, D.LessThan | D.LessThanOrEqual | D.EqualTo):
                    self.last = min(self.last, value - one if isinstance(f, D.LessThan) else value)
            elif not (column in (("symbol",), ("date",)) and isinstance(f, D.IsNotNull)):  # neither is ever null
                yield f


@dataclass
class Written(D.WriterCommitMessage):
    files: list[str]


class Writer(D.DataSourceWriter):
    """Of a folder symbol=<name>/ per symbol, as this source reads it."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Written:
        fs, root = _at(self.path)
        files, streams = [], {}

        def shut() -> None:
            for s in streams.values():
                s.close()
            streams.clear()

        for r in rows:
            r = r.asDict()
            symbol = r["symbol"] or "IMPORT"
            if r["date"] is None:
                raise BadCsv(f"a row of {symbol} has no date")
            if symbol not in streams:
                if len(streams) >= OPEN_FILES:
                    shut()
                name = f"symbol={quote(symbol, safe='')}/part-{uuid.uuid4().hex}.csv"
                fs.create_dir(f"{root}/_staging-{self.run}/{name.rpartition('/')[0]}", recursive=True)
                streams[symbol] = fs.open_output_stream(f"{root}/_staging-{self.run}/{name}")
                streams[symbol].write(f"date,{','.join(FIELDS)}\n".encode())
                files.append(name)
            values = ["n/a" if r.get(f) is None else repr(float(r[f])) for f in FIELDS]  # unreadable on purpose: readers fill it in
            streams[symbol].write(f"{r['date'].isoformat()},{','.join(values)}\n".encode())
        shut()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _at(self.path)
        before = _latest(fs, root) or (0, [])
        new = [f for m in messages if m for f in m.files]
        for name in new:
            fs.create_dir(f"{root}/{name.rpartition('/')[0]}", recursive=True)
            fs.move(f"{root}/_staging-{self.run}/{name}", f"{root}/{name}")
        fs.create_dir(root, recursive=True)
        staged = f"{root}/_staging-{self.run}.json"
        with fs.open_output_stream(staged) as f:
            f.write(json.dumps(new if self.overwrite else before[1] + new).encode())
        fs.move(staged, f"{root}/_files-{before[0] + 1}.json")
        self._drop(fs, f"{root}/_staging-{self.run}")
        if self.overwrite:
            for name in before[1]:
                fs.delete_file(f"{root}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _at(self.path)
        self._drop(fs, f"{root}/_staging-{self.run}")

    @staticmethod
    def _drop(fs: pafs.FileSystem, folder: str) -> None:
        if fs.get_file_info(folder).type == pafs.FileType.Directory:
            fs.delete_dir(folder)
