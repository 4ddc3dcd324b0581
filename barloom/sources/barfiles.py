"""Bar archives in files of fixed-length records, as a Spark data source.

A file has a header of 64 bytes and records of 48: a time and five doubles, in order of time.
Files are split into ranges of records, each a partition; bounds on the time are found in the records by
binary search, so that a reader opens only the records it needs. Writers give each
file a hidden name first, and the commit of the whole job renames them.

``path`` may be any address that pyarrow can open (a local or shared folder, HDFS, an object
store), from the driver and from executors.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from ..operators.bars import TIMEFRAMES

SCHEMA = "symbol string, timeframe string, data_type string, ts long, open double, high double, low double, close double, volume double"
# Fixed values of the format: header, record, and the numbers of data types.
MAGIC, VERSION, SUFFIX = b"STCHXBF1", 2, ".bars"
HEADER, HEADER_BYTES = ">8sHHHBBQ16s4sd12x", 64
RECORD = np.dtype([("ts", ">u8"), ("open", ">f8"), ("high", ">f8"), ("low", ">f8"), ("close", ">f8"), ("volume", ">f8")])
DATA_TYPES = {1: "ohlcv", 2: "heikenashi", 3: "renko", 4: "atr_renko"}
COUNT_AT = 16
#: Records of a partition, and of a batch.
SPLIT, BATCH = 1 << 20, 1 << 16


class BadFile(ValueError):
    """A file that is not one of these archives."""


@dataclass(frozen=True)
class Header:
    symbol: str
    timeframe: str
    data_type: str = "ohlcv"
    records: int = 0
    brick_size: float = 0.0

    def packed(self) -> bytes:
        kind = {v: k for k, v in DATA_TYPES.items()}[self.data_type]
        symbol, frame = self.symbol.encode(), self.timeframe.encode()
        if len(symbol) > 16 or len(frame) > 4:
            raise ValueError(f"{self.symbol} or {self.timeframe} is too long for a header")
        return struct.pack(HEADER, MAGIC, VERSION, HEADER_BYTES, RECORD.itemsize, 1, kind, self.records, symbol, frame, self.brick_size)

    @staticmethod
    def parsed(raw: bytes, name: str) -> Header:
        if len(raw) < HEADER_BYTES:
            raise BadFile(f"{name} has no whole header")
        magic, version, length, record, _, kind, records, symbol, frame, size = struct.unpack(HEADER, raw[:HEADER_BYTES])
        if magic != MAGIC or version not in (1, VERSION) or length != HEADER_BYTES or record != RECORD.itemsize or kind not in DATA_TYPES:
            raise BadFile(f"{name} is no bar archive of a known version")
        text = lambda b: b.rstrip(b"\0").decode()
        return Header(text(symbol), text(frame), DATA_TYPES[kind], records, size)


def _filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def _files(path: str) -> tuple[pa.fs.FileSystem, list[tuple[str, int]]]:
    from pyarrow import fs

    system, folder = _filesystem(path)
    found = system.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
    own = lambda f: f.is_file and f.base_name.endswith(SUFFIX) and not f.base_name.startswith(".")
    return system, sorted((f.path, f.size) for f in found if own(f))


def _records_in(size: int) -> int:
    """Whole records of a file; its length rules where the header was not brought up to date."""
    return max(0, size - HEADER_BYTES) // RECORD.itemsize


def _read(stream, first: int, n: int) -> np.ndarray:
    stream.seek(HEADER_BYTES + first * RECORD.itemsize)
    return np.frombuffer(stream.read(n * RECORD.itemsize), RECORD)


def _place(stream, n: int, ts: int) -> int:
    """How many records lie before a time, by binary search."""
    low, high = 0, n
    while low < high:
        middle = (low + high) // 2
        low, high = (middle + 1, high) if int(_read(stream, middle, 1)["ts"][0]) < ts else (low, middle)
    return low


class Records(InputPartition):
    def __init__(self, path: str, header: Header, first: int, last: int) -> None:
        self.path, self.header, self.first, self.last = path, header, first, last


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options
        self.start = int(options["start"]) if "start" in options else None
        self.stop = int(options["stop"]) if "stop" in options else None
        self.equal = {k: options[k] for k in ("symbol", "timeframe", "data_type") if k in options}

    def partitions(self) -> list[Records]:
        system, files = _files(self.options["path"])
        split, found = int(self.options.get("split", SPLIT)), []
        for path, size in files:
            with system.open_input_file(path) as stream:
                header, n = Header.parsed(stream.read(HEADER_BYTES), path), _records_in(size)
                if any(getattr(header, k) != v for k, v in self.equal.items()):
                    continue
                first = _place(stream, n, self.start) if self.start is not None else 0
                last = _place(stream, n, self.stop + 1) if self.stop is not None else n
            found += [Records(path, header, a, min(a + split, last)) for a in range(first, last, split)]
        return found

    def read(self, part: Records | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # there are no partitions
            return
        system, _ = _filesystem(self.options["path"])
        with system.open_input_file(part.path) as stream:
            for a in range(part.first, part.last, BATCH):
                rows = _read(stream, a, min(BATCH, part.last - a))
                fixed = [pa.array([v] * len(rows), pa.string()) for v in (part.header.symbol, part.header.timeframe, part.header.data_type)]
                values = [pa.array(rows["ts"].astype(np.int64)), *(pa.array(rows[c].astype(np.float64)) for c in RECORD.names[1:])]
                yield pa.RecordBatch.from_arrays([*fixed, *values], names=["symbol", "timeframe", "data_type", *RECORD.names])


class PushingReader(Reader):
    """For sessions that push filters down to Python sources; others refuse a reader that takes them."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds of the time narrow the records; Spark tests all filters again."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name == "ts" and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                low = f.value + isinstance(f, GreaterThan)
                self.start = low if self.start is None else max(self.start, low)
            if name == "ts" and isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                high = f.value - isinstance(f, LessThan)
                self.stop = high if self.stop is None else min(self.stop, high)
            if name in ("symbol", "timeframe", "data_type") and isinstance(f, EqualTo):
                self.equal.setdefault(name, f.value)
            yield f


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # hidden and final name


class Writer(DataSourceArrowWriter):
    """Rows come in order of symbol, file and time; each symbol and file becomes an archive when the job commits."""

    def __init__(self, options: dict) -> None:
        self.options = options

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = _filesystem(self.options["path"])
        frame, kind, brick = self.options["timeframe"], self.options.get("data_type", "ohlcv"), float(self.options.get("brick_size", 0))
        system.create_dir(folder, recursive=True)
        files, open_, now, count = [], None, None, 0

        def finish() -> None:
            if open_ is not None:
                open_.close()
                self._count(system, files[-1][0], count)

        for batch in iterator:
            table = batch.to_pydict()
            keys = list(zip(table["symbol"], table["file"], strict=True))
            bounds = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)] if keys else [0]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if keys[a] != now:
                    finish()
                    now, count = keys[a], 0
                    symbol, file = now
                    name = f"{symbol}-{frame}-{kind}-{file}{SUFFIX}"
                    hidden = f"{folder}/.{uuid.uuid4().hex}-{name}"
                    files.append((hidden, f"{folder}/{name}"))
                    open_ = system.open_output_stream(hidden)
                    open_.write(Header(symbol, frame, kind, 0, brick).packed())
                rows = np.empty(b - a, RECORD)
                for c in RECORD.names:
                    rows[c] = table[c][a:b]
                open_.write(rows.tobytes())
                count += b - a
        finish()
        return Written(files)

    @staticmethod
    def _count(system, name: str, records: int) -> None:
        """Put the number of records into the header, where files can be changed in place; else their length tells it."""
        from pyarrow import fs

        if isinstance(system, fs.LocalFileSystem):
            with open(name, "r+b") as f:
                f.seek(COUNT_AT)
                f.write(struct.pack(">Q", records))

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = _filesystem(self.options["path"])
        for m in messages:
            for hidden, name in m.files if m else ():
                system.move(hidden, name)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = _filesystem(self.options["path"])
        for m in messages:
            for hidden, _ in m.files if m else ():
                system.delete_file(hidden)


class BarFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bar_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return (PushingReader if self.options.get("pushdown") == "true" else Reader)(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options)


def read(spark: SparkSession, path: str, start: int | None = None, stop: int | None = None, **equal: str) -> DataFrame:
    """Bars of all archives under ``path``, within inclusive bounds of the time, of a ``symbol``, ``timeframe`` or ``data_type``.

    The columns of ``SCHEMA``. Where the session pushes filters down to Python sources, a
    ``where`` on the time narrows what is read as the bounds do.
    """
    spark.dataSource.register(BarFiles)
    options = {"path": path, "pushdown": spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")} | equal | ({"start": start} if start is not None else {}) | ({"stop": stop} if stop is not None else {})
    return spark.read.format("bar_files").options(**options).load()


def write(bars: DataFrame, path: str, timeframe: str, data_type: str = "ohlcv", brick_size: float = 0.0, bars_per_file: int = SPLIT) -> None:
    """Write bars as archives, one for each symbol and stretch of time; an archive of the same name is replaced."""
    spark = bars.sparkSession
    spark.dataSource.register(BarFiles)
    file = F.floor(F.col("ts") / (TIMEFRAMES[timeframe] * bars_per_file)).alias("file")
    shaped = bars.select("symbol", file, "ts", "open", "high", "low", "close", "volume")
    dealt = shaped.repartition("symbol", "file").sortWithinPartitions("symbol", "file", "ts")
    dealt.write.format("bar_files").options(path=path, timeframe=timeframe, data_type=data_type, brick_size=brick_size).mode("append").save()


def describe(spark: SparkSession, path: str) -> DataFrame:
    """Every archive with its header, the records that its length holds, and whether the header agrees."""
    system, files = _files(path)
    rows = []
    for name, size in files:
        with system.open_input_file(name) as stream:
            h = Header.parsed(stream.read(HEADER_BYTES), name)
        rows.append((name, h.symbol, h.timeframe, h.data_type, h.records, _records_in(size), h.records == _records_in(size)))
    return spark.createDataFrame(rows, "file string, symbol string, timeframe string, data_type string, header_records long, records long, agrees boolean")


def repair(path: str) -> int:
    """Bring the headers of archives in a local or shared folder up to date; the number of those that were not."""
    system, files = _files(path)
    wrong = 0
    for name, size in files:
        with system.open_input_file(name) as stream:
            h = Header.parsed(stream.read(HEADER_BYTES), name)
        if h.records != _records_in(size):
            Writer._count(system, name, _records_in(size))
            wrong += 1
    return wrong
