"""WARC archives as tables of chunks.

Writing: each page streams out as chunks (record id, chunk number), each at most
``CHUNK_BYTES`` long and each a WARC record: the first of its real type, the rest
of type ``continuation`` with segment numbers, which is the standard's own form for
oversized payloads. A running SHA-256 goes along, so that no step holds more than
one chunk besides the cell that Spark hands over. Archives are gzip text files
whose line end is the record end.

Reading: the files are split at record starts, so a row is one chunk. Chunks of a
record meet sorted by number, and the digest is carried from chunk to chunk.

A payload that holds the record separator itself is cut inside it, so that no
chunk can be mistaken for two.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from docmill.llm.common import store
from docmill.session import work_dir

CHUNK_BYTES = 256 << 10
MIN_REVISIT_BYTES = 100
# Fixed values of the format.
VERSION = "WARC/1.1"
END = "\r\n\r\n"
SEPARATOR = END + VERSION + "\r\n"

CHUNKS = "record_id string, chunk_no long, record string, payload_sha256 string"


_MARK = re.compile(re.escape((END + VERSION).encode()))


def cuts(payload: bytes | memoryview, size: int) -> Iterator[tuple[int, int]]:
    """Chunk bounds: at most ``size`` bytes, whole characters, no separator inside nor
    between a chunk and the end of the header before it. Reads on as it is asked."""
    start, reach = 0, len(VERSION) + len(END)
    while start < len(payload):
        end = min(start + size, len(payload))
        mark = _MARK.search(END.encode() + bytes(payload[start:start + reach]))
        if mark:
            end = min(end, start + mark.start() + 1)
        if mark := _MARK.search(payload, start, end):
            end = mark.start() + len(END) + 1
        while end < len(payload) and end > start + 4 and payload[end] & 0xC0 == 0x80:
            end -= 1
        yield start, end
        start = end
    if not len(payload):
        yield 0, 0


def _header(fields: list[tuple[str, object]]) -> str:
    return VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"


#: Stands for a null page id; no quoted value holds it.
NULL = "%-"


def _quote(value: object) -> str:
    """One header line that :func:`_unquoted` turns back, whatever the value holds."""
    return NULL if value is None else str(value).replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unquoted(value: Column) -> Column:
    for code, char in (("%0D", "\r"), ("%0A", "\n"), ("%25", "%")):
        value = F.replace(value, F.lit(code), F.lit(char))
    return value


def _chunks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            out, held = ([], [], [], []), 0
            for key, url, html, refers in zip(*(batch.column(i) for i in range(4))):
                key, url, refers = key.as_py(), url.as_py(), refers.as_py()
                data = memoryview(html.as_buffer())     # the cell itself, not a copy
                n += 1
                record = f"<urn:docmill:{part}-{n}>"
                running = hashlib.sha256()
                if refers is not None:
                    running.update(data)
                for k, (start, end) in enumerate(cuts(data, size) if refers is None else [(0, 0)]):
                    piece = data[start:end]
                    running.update(piece)
                    last = refers is not None or end == len(data)
                    kind = "continuation" if k else "response" if refers is None else "revisit"
                    fields = [("WARC-Type", kind), ("WARC-Record-ID", record if not k else f"{record[:-1]}-{k}>"),
                              ("WARC-Page-ID", _quote(key)), ("WARC-Target-URI", _quote(url))]
                    if refers is not None:
                        fields += [("WARC-Refers-To", _quote(refers)), ("WARC-Payload-Digest", f"sha256:{running.hexdigest()}"),
                                   ("WARC-Payload-Length", len(data))]
                    if k or not last:
                        fields += [("WARC-Segment-Origin-ID", record), ("WARC-Segment-Number", k + 1),
                                   ("WARC-Running-Digest", f"sha256:{running.hexdigest()}")]
                        if last:
                            fields += [("WARC-Segment-Total-Length", len(data))]
                    fields += [("Content-Length", len(piece))]
                    row = (record, k + 1, _header(fields) + str(piece, "utf-8"), running.hexdigest())
                    held += len(row[2])
                    for column, value in zip(out, row):
                        column.append(value)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1], pa.int64()), pa.array(out[2]), pa.array(out[3])], names=["record_id", "chunk_no", "record", "payload_sha256"])
                        out, held = ([], [], [], []), 0
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1], pa.int64()), pa.array(out[2]), pa.array(out[3])], names=["record_id", "chunk_no", "record", "payload_sha256"])
    return run


def chunk_records(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of ``pages``: ``record_id, chunk_no, record, payload_sha256``.

    ``record`` is the chunk as WARC text, ``payload_sha256`` the digest of the
    payload up to its end. Of payloads that are equal and at least 100 bytes long,
    the one with the smallest ``page_id`` is a response and the rest revisit it;
    rows that repeat this id are responses too, and without any id all are. A null
    payload is empty. Other columns are ignored.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    firsts = store(
        rows.where(F.octet_length("html") >= MIN_REVISIT_BYTES).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "first-pages")
    # an unmatched or first record refers to nothing; hot digests are split by the skew join
    roles = rows.join(firsts, "digest", "left").select(
        F.col("page_id").cast("string"), "url", "html",
        F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).cast("string").alias("refers"))
    return roles.mapInArrow(_chunks(chunk_bytes), CHUNKS)


def write_archives(pages: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write ``pages`` as ``.gz`` WARC files under ``path``."""
    (chunk_records(pages, chunk_bytes).select("record").write
     .option("lineSep", END).option("compression", "gzip").text(path))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold sorted chunks to one row per record; only the digest is carried."""
    now, running, length, first = None, None, 0, None
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def row():
        return [first, length, running.hexdigest(), "response", None]

    def emit(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()))],
            names=names)

    for batch in batches:
        rows = []
        for origin, page, payload in zip(*(batch.column(i) for i in range(3))):
            if origin.as_py() != now:
                if now is not None:
                    rows.append(row())
                now, running, length, first = origin.as_py(), hashlib.sha256(), 0, page.as_py()
            data = payload.as_buffer()
            running.update(data)
            length += len(data)
        if rows:
            yield emit(rows)
    if now is not None:
        yield emit([row()])


def read_archives(spark, path: str) -> DataFrame:
    """``page_id (string), payload_bytes, payload_digest, record_type, refers_to``.

    One row per record, in no order. Digest and length of a response are computed
    from the archived payload; a revisit's are those in its header.
    """
    raw = spark.read.option("lineSep", SEPARATOR).text(path).select(
        F.regexp_replace("value", r"^WARC/1\.1\r\n", "").alias("value")).where("value <> ''")
    head = F.substring_index("value", END, 1)
    # a field starts a line: values hold no line ends, so none can pass for another field
    field = lambda name: F.when(
        F.regexp_like("head", F.lit(rf"(?:^|\n){name}: ")), F.regexp_extract("head", rf"(?:^|\n){name}: ([^\r\n]*)", 1))
    value = lambda name: _unquoted(F.nullif(field(name), F.lit(NULL)))
    rows = raw.select(head.alias("head"), F.col("value").cast("binary").alias("data")).select(
        value("WARC-Page-ID").alias("page_id"), field("WARC-Type").alias("kind"),
        field("WARC-Segment-Origin-ID").alias("origin"), field("WARC-Segment-Number").cast("long").alias("no"),
        value("WARC-Refers-To").alias("refers_to"), field("WARC-Payload-Digest").alias("digest"),
        field("WARC-Payload-Length").cast("long").alias("length"),
        F.substring("data", F.octet_length("head") + len(END) + 1, field("Content-Length").cast("int")).alias("payload"))
    single = rows.where("origin is null").select(
        "page_id",
        F.when(F.col("kind") == "revisit", F.col("length")).otherwise(F.octet_length("payload")).cast("long").alias("payload_bytes"),
        F.when(F.col("kind") == "revisit", F.substring_index("digest", ":", -1)).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        F.col("kind").alias("record_type"), "refers_to")
    chunked = (rows.where("origin is not null").select("origin", "page_id", "payload", "no")
               .repartition("origin").sortWithinPartitions("origin", "no").drop("no"))
    return single.union(chunked.mapInArrow(
        _digests, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"))


def warc_round_trip(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    spark, kind = pages.sparkSession, dict(pages.dtypes)["page_id"]
    path = work_dir(spark, "warc")
    write_archives(pages, path, chunk_bytes)
    back = read_archives(spark, path)
    return back.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})
