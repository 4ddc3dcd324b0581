"""Web archives: segmented WARC records, written by Spark and reassembled.

Archives are written by Spark's text writer with the WARC record end as line
separator, so records of raw bytes go through its commit protocol to any file
system. A long block is split into segments: the first record carries
``WARC-Segment-Number: 1``, continuations name it in ``WARC-Segment-Origin-ID``, and
the last one states ``WARC-Segment-Total-Length``. Reading groups segments by origin,
orders them by number, verifies the total length, and decodes chunked framing as a
stream, so that a record's length bounds no buffer. A revisit is checked against the
response that it refers to.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import skew  # noqa: F401
from .idfilter import marked
from .skew import hot_keys, join_split
from .storage import Scratch, materialise, remove, scratch_path

#: Most pages are longer, so that their blocks lie in several records.
SEGMENT_BYTES = 1 << 11
CHUNK_BYTES = 1 << 13
#: Records of an archive file at most; with the segment size, this bounds its bytes.
ARCHIVE_RECORDS = 1 << 15
REVISIT_FROM = 1000
RECORD_END = "\r\n\r\n"

SEGMENTS = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("origin_id", T.StringType()),
        T.StructField("segment", T.LongType()),
        T.StructField("total_length", T.LongType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("stated_digest", T.StringType()),
        T.StructField("stated_length", T.LongType()),
        T.StructField("block", T.BinaryType()),
    ]
)
RECORDS = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("segments", T.LongType()),
        T.StructField("length_ok", T.BooleanType()),
        T.StructField("digest_ok", T.BooleanType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


#: Stands for a null page_id in keys.
NO_PAGE = -(1 << 63)


def _row_key(page: str = "page_id"):
    return F.xxhash64(F.coalesce(F.col(page), F.lit(NO_PAGE)), F.col("digest"))


def plan_revisits(pages: DataFrame, least_bytes: int = REVISIT_FROM, scratch: Scratch | None = None) -> DataFrame:
    """``page_id, url, payload, payload_bytes, digest, refers_to`` of pages with ``page_id, url, payload`` (binary).

    Of equal payloads of at least ``least_bytes`` the page with the largest page_id
    is stored; the others refer to it and lose their payload. Rows that repeat
    the largest page_id are all stored; a null page_id refers to the group's largest.
    Groups are found and joined by digests alone; digests that many pages share are
    salted. Payloads are shuffled only of pages that a bitmap takes for revisits. The
    result reads tables of digests that are cleared with ``scratch``.
    """
    keep = (scratch or Scratch()).keep
    hashed = pages.select("page_id", "url", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("digest"))
    narrow = keep(hashed.drop("payload"), "digests")
    long = narrow.where(F.col("payload_bytes") >= least_bytes)
    shared = keep(long.groupBy("digest").agg(F.max("page_id").alias("kept_id"), F.count("*").alias("copies")).where("copies > 1").withColumn("digest_key", F.xxhash64("digest")), "shared")
    hot = hot_keys(shared, "digest_key", "copies")
    keyed = long.withColumn("digest_key", F.xxhash64("digest"))
    again = join_split(keyed, shared.select("digest", "digest_key", "kept_id"), ["digest", "digest_key"], "digest_key", hot, "page_id")
    again = keep(again.where(~F.col("page_id").eqNullSafe(F.col("kept_id"))).select("page_id", "url", "payload_bytes", "digest", F.col("kept_id").alias("refers_to")), "revisits")
    keys = again.select(_row_key().alias("revisit")).distinct()
    told = marked(hashed.withColumn("row_key", _row_key()), "row_key", keys, "maybe")
    clear = told.where("not maybe").unionAll(told.where("maybe").join(again.select(F.col("page_id").alias("p"), F.col("digest").alias("d")).distinct(), F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left_anti"))
    stored = clear.select("page_id", "url", "payload", "payload_bytes", "digest", F.lit(None).cast("long").alias("refers_to"))
    return stored.unionAll(again.select("page_id", "url", F.lit(None).cast("binary").alias("payload"), "payload_bytes", "digest", "refers_to"))


def _field(name: str, value) -> bytes:
    text = re.sub(r"[\r\n]+", " ", str(value))
    return f"{name}: {text}\r\n".encode("utf-8", "surrogatepass")


def _chunked(payload: bytes, size: int) -> bytes:
    out = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def _writer(segment_bytes: int, chunk_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            out, held = [], 0
            for page, url, payload, size, digest, refers in zip(*columns, strict=True):
                name = f"<urn:page:{'' if page is None else page}:{task}:{row}>"
                row += 1
                revisit = refers is not None
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                if revisit:
                    block = http + b"Content-Length: %d\r\n\r\n" % size
                else:
                    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + _chunked(payload, chunk_bytes)
                parts = [block[a : a + segment_bytes] for a in range(0, len(block), segment_bytes)]
                for number, part in enumerate(parts, 1):
                    first = number == 1
                    kind = ("revisit" if revisit else "response") if first else "continuation"
                    head = b"WARC/1.1\r\n" + _field("WARC-Type", kind)
                    head += _field("WARC-Record-ID", name if first else f"{name[:-1]}:{number}>")
                    head += _field("WARC-Date", "2024-01-01T00:00:00Z") + _field("Content-Length", len(part))
                    if url is not None:
                        head += _field("WARC-Target-URI", url)
                    if first:
                        head += _field("Content-Type", "application/http; msgtype=response") + _field("WARC-Payload-Digest", f"sha1:{digest}")
                    if revisit:
                        head += _field("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
                        head += _field("WARC-Refers-To", f"<urn:page:{refers}>")
                    if len(parts) > 1:
                        head += _field("WARC-Segment-Number", number)
                        if not first:
                            head += _field("WARC-Segment-Origin-ID", name)
                        if number == len(parts):
                            head += _field("WARC-Segment-Total-Length", len(block))
                    record = head + b"\r\n" + part
                    out.append(record)
                    held += len(record)
                if held >= 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    return write


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, archive_records: int = ARCHIVE_RECORDS) -> None:
    """Write pages (``page_id, url, payload, payload_bytes, digest, refers_to``) as gzip-compressed WARC files.

    Files follow the partitions of ``pages``; a partition begins a new archive after
    so many records. Segments of one record may lie in two archives.
    """
    records = pages.select("page_id", "url", "payload", "payload_bytes", "digest", "refers_to").mapInArrow(_writer(segment_bytes, chunk_bytes), "value binary")
    # the cast keeps the bytes as they are; the writer puts the record end after each
    lines = records.select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", archive_records).text(path)


def _inflate(blob, size: int = 1 << 18) -> Iterator[bytes]:
    """Pieces of an archive: plain, one gzip member, or one member for each record."""
    view = memoryview(blob)
    if bytes(view[:2]) != b"\x1f\x8b":
        for at in range(0, len(view), size):
            yield bytes(view[at : at + size])
        return
    at = 0
    while at < len(view):
        inflater, step = zlib.decompressobj(31), 1 << 12  # a member may be short
        while at < len(view) and not inflater.eof:
            piece = inflater.decompress(view[at : at + step])
            at = min(at + step, len(view)) - len(inflater.unused_data)
            step = min(2 * step, size)
            if piece:
                yield piece


def _records(blob) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an archive."""
    held, pieces, done = bytearray(), _inflate(blob), False
    while True:
        while (stop := held.find(b"\r\n\r\n")) < 0 and not done:
            piece = next(pieces, None)
            done = piece is None
            held += piece or b""
        if stop < 0:
            return
        head = bytes(held[:stop]).decode("utf-8", "surrogateescape").lstrip("\r\n")
        if not head:  # record ends that nothing follows
            del held[: stop + 4]
            continue
        fields = {}
        for line in head.split("\r\n")[1:]:
            key, _, value = line.partition(":")
            fields[key.strip().lower()] = value.strip()
        size = int(fields.get("content-length", 0))
        while len(held) < stop + 4 + size and not done:
            piece = next(pieces, None)
            done = piece is None
            held += piece or b""
        yield fields, bytes(held[stop + 4 : stop + 4 + size])
        del held[: stop + 4 + size + 4]


def _whole(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?\d+", text) else None


def _page(urn: str | None) -> int | None:
    found = re.match(r"<urn:page:(-?\d+)", urn or "")
    return int(found[1]) if found else None


def read_segments(spark, path: str) -> DataFrame:
    """Every WARC record under ``path``: one row per segment, with its block."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                rows, held = [], 0
                for fields, block in _records(archive.as_buffer()):
                    name = fields.get("warc-record-id")
                    origin = fields.get("warc-segment-origin-id", name)
                    number = _whole(fields.get("warc-segment-number"))
                    digest = fields.get("warc-payload-digest", "")
                    stated = re.search(rb"\r\nContent-Length: (\d+)", block) if fields.get("warc-type") == "revisit" else None
                    rows.append((name, origin, number, _whole(fields.get("warc-segment-total-length")), fields.get("warc-type"), _page(origin), _page(fields.get("warc-refers-to")), fields.get("warc-target-uri"), digest.rpartition(":")[2] or None, int(stated[1]) if stated else None, block))
                    held += len(block)
                    if held >= 1 << 22:
                        yield _batch(rows, SEGMENTS)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, SEGMENTS)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, SEGMENTS)


_ARROW = {T.StringType: pa.string(), T.LongType: pa.int64(), T.BinaryType: pa.binary(), T.BooleanType: pa.bool_()}


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), _ARROW[type(f.dataType)]) for c, f in zip(columns, schema, strict=True)], names=schema.names)


class _Message:
    """An HTTP message that arrives in pieces: headers, then a body with or without chunked framing."""

    def __init__(self, keep: bool) -> None:
        self.held, self.state, self.left = bytearray(), "head", 0
        self.sha, self.size, self.keep, self.body = hashlib.sha1(), 0, keep, bytearray()
        self.sound = True

    def _take(self, data: bytes) -> None:
        self.sha.update(data)
        self.size += len(data)
        if self.keep:
            self.body += data

    def feed(self, data: bytes) -> None:
        held = self.held
        held += data
        while True:
            if self.state == "head":
                stop = held.find(b"\r\n\r\n")
                if stop < 0:
                    return
                chunked = re.search(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked\b", bytes(held[:stop]))
                del held[: stop + 4]
                self.state = "size" if chunked else "plain"
            elif self.state == "plain":
                self._take(bytes(held))
                held.clear()
                return
            elif self.state == "size":
                stop = held.find(b"\r\n")
                if stop < 0:
                    return
                try:
                    self.left = int(bytes(held[:stop]).split(b";")[0], 16)
                except ValueError:
                    self.sound, self.state = False, "end"
                    return
                del held[: stop + 2]
                self.state = "chunk" if self.left else "end"
            elif self.state == "chunk":
                part = bytes(held[: self.left])
                self._take(part)
                del held[: len(part)]
                self.left -= len(part)
                if self.left:
                    return
                self.state = "gap"
            elif self.state == "gap":
                if len(held) < 2:
                    return
                del held[:2]
                self.state = "size"
            else:
                return

    def complete(self) -> bool:
        return self.sound and self.state in ("plain", "end")


def _reassembler(keep_payload: bool):
    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, message, seen, bytes_in, total, expected, sound = None, None, 0, 0, None, 1, True
        out, held = [], 0

        def close():
            if first is None:
                return
            length_ok = sound and (total is None and seen == 1 or total == bytes_in)
            if first["record_type"] == "revisit":
                out.append((first["record_id"], first["page_id"], "revisit", first["refers_to"], first["target_uri"], seen, length_ok, None, first["stated_length"], first["stated_digest"], None))
                return
            digest = message.sha.hexdigest()
            good = message.complete() and (first["stated_digest"] is None or first["stated_digest"] == digest)
            out.append((first["record_id"], first["page_id"], first["record_type"], None, first["target_uri"], seen, length_ok, good, message.size, digest, bytes(message.body) if keep_payload else None))

        for batch in batches:
            for row in batch.to_pylist():
                if first is None or row["origin_id"] != origin:  # noqa: F821
                    close()
                    first, origin, message = row, row["origin_id"], _Message(keep_payload)
                    seen, bytes_in, total, expected, sound = 0, 0, None, 1, True
                if row["segment"] is not None and row["segment"] != expected:
                    sound = False  # a segment is missing or comes twice
                seen, expected, bytes_in = seen + 1, expected + 1, bytes_in + len(row["block"])
                total = row["total_length"] if row["total_length"] is not None else total
                message.feed(row["block"])
            held = sum(len(r[10] or b"") for r in out)
            if out and (len(out) >= 2000 or held >= 1 << 22):
                yield _batch(out, RECORDS)
                out = []
        close()
        if out:
            yield _batch(out, RECORDS)

    return reassemble


def reassemble(segments: DataFrame, keep_payload: bool = True) -> DataFrame:
    """Whole records from the rows of :func:`read_segments`.

    Segments are dealt by origin and sorted by number within the task; one record at
    a time is decoded as a stream. ``length_ok`` tells that the segment numbers run
    from 1 without a gap and their lengths add up to the stated total; ``digest_ok``
    that the framing is whole and the payload has the stated digest. A revisit has no
    payload; its size and digest are those stated, and its ``digest_ok`` is null until
    :func:`check_revisits` compares it with the response.
    """
    dealt = segments.repartition(F.col("origin_id")).sortWithinPartitions("origin_id", "segment")
    return dealt.mapInArrow(_reassembler(keep_payload), RECORDS)


def check_revisits(records: DataFrame) -> DataFrame:
    """Records (a table that can be read again) whose revisits have ``digest_ok``: whether the
    response they refer to is there, sound, and of the stated digest and size."""
    of = records.where("record_type = 'response' and digest_ok and length_ok").select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("n"), F.lit(True).alias("met")).distinct()
    again = records.where("record_type = 'revisit'")
    times = again.groupBy("refers_to").agg(F.count("*").alias("times"))
    hot = hot_keys(times, "refers_to", "times")
    keyed = again.withColumn("d", F.col("payload_digest")).withColumn("n", F.col("payload_bytes"))
    compared = join_split(keyed, of, ["refers_to", "d", "n"], "refers_to", hot, "record_id", "left")
    checked = compared.withColumn("digest_ok", F.coalesce("met", F.lit(False))).select(*records.columns)
    return records.where("record_type <> 'revisit'").unionAll(checked)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``page_id, url, html`` as archives and read the records back.

    A row per page with ``page_id, payload_bytes, payload_digest, record_type,
    refers_to``, the number of segments and whether length and digest were verified.
    Null html is an empty payload, a null url a record without target, a null page_id
    stays null, repeated rows are records of their own. A very long page lies in many
    segments and is decoded as a stream. Other columns are ignored, whatever their
    names; an empty table gives no rows.
    """
    spark = pages.sparkSession
    shaped = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"))
    path, scratch = scratch_path(spark, "warc"), Scratch()
    write_archives(plan_revisits(shaped, scratch=scratch), path)
    scratch.clear()
    segments = read_segments(spark, path)
    records = materialise(reassemble(segments, keep_payload=False).drop("payload"), "records")
    remove(spark, path)
    return check_revisits(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "segments", "length_ok", "digest_ok")
