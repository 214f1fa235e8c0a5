"""Zstandard web archives: a writer, and the reader (operator 8).

An archive is a leading skippable frame that holds the dictionary (itself
compressed), then one frame for each record.  Frames are rows of a text
table whose line end is an empty skippable frame, so Spark's own writer and
commit protocol make the files, in any store that Spark writes to, and any
Zstandard reader passes over the separators.  A new archive begins after
ARCHIVE_BYTES of frames, so a file fits a reader's memory.

The reader loads the dictionary, decodes a frame a record and validates:
version line, required headers, block length against Content-Length, the
closing blank lines, the block's digest, and a response's payload length and
digest.  Anything else raises ValueError.

Of pages with equal payloads of ``least`` bytes or more, the one of smallest
id is a response and the others are revisits that refer to it; other pages
are responses.

Defined cases: null html is an empty payload; a page without id is a
response, or a revisit if a page with an id has its payload; rows that tie
for the smallest id are all responses; null addresses are left out of the
record; extra columns are ignored; an empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formspark.llm import common

#: Fixed values of the formats: the dictionary frame's and other skippable frames' magic numbers.
DICTIONARY_MAGIC, SKIPPABLE_LOW, SKIPPABLE_HIGH, FRAME_MAGIC = 0x184D2A5D, 0x184D2A50, 0x184D2A5F, 0xFD2FB528
#: An empty skippable frame; all its bytes are ASCII.
SEPARATOR = struct.pack("<II", SKIPPABLE_LOW, 0)
#: Pages that the dictionary is trained on, and bytes of each, at most.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 16_384, 65_536
#: Compressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 32 << 20
#: A payload that this share of all pages has is common: there can be a thousand at most.
COMMON = 1000
_DATE = "2024-01-01T00:00:00Z"
_CHUNK = 1 << 16


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page: int | None) -> str:
    return f"<urn:x-page:{'none' if page is None else page}>"


def record(page: int | None, url: str | None, payload: bytes, refers: int | None) -> bytes:
    """A record's bytes; a revisit, without payload, if it refers to a page."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers is None:
        block += payload
    fields = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", _name(page)), ("WARC-Date", _DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", " ".join(url.split())))
    if refers is not None:
        fields += [("WARC-Refers-To", _name(refers)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record, validated."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not blank or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"not a record: {lines[0][:40]!r}")
    headers = {}
    for line in lines[1:]:
        key, colon, value = line.partition(":")
        if not colon or not key or key != key.strip():
            raise ValueError(f"bad header line {line[:60]!r}")
        headers[key.lower()] = value.strip()
    for key in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if key not in headers:
            raise ValueError(f"no {key} header")
    length = int(headers["content-length"])
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"record of {len(rest) - 4} bytes, {length} declared")
    if headers.get("warc-block-digest", f"sha1:{digest(block)}") != f"sha1:{digest(block)}":
        raise ValueError("block digest differs")
    return headers, block


def http_payload(headers: dict[str, str], block: bytes) -> tuple[int, bytes]:
    """Length of the full payload and, of a response, its bytes, validated."""
    head, _, payload = block.partition(b"\r\n\r\n")
    lengths = [int(x.split(b":", 1)[1]) for x in head.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
    length = lengths[0] if lengths else len(payload)
    if headers["warc-type"] == "response":
        if length != len(payload):
            raise ValueError(f"payload of {len(payload)} bytes, {length} declared")
        if headers.get("warc-payload-digest", f"sha1:{digest(payload)}") != f"sha1:{digest(payload)}":
            raise ValueError("payload digest differs")
    return length, payload


def dictionary_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed


def frames(data: bytes) -> Iterator[bytes]:
    """The decoded frames of an archive; skippable ones are passed over."""
    view, at, dictionary = memoryview(data), 0, None
    while at < len(view):
        if len(view) - at < 8:
            raise ValueError("the archive ends inside a frame")
        magic, length = struct.unpack_from("<II", view, at)
        if SKIPPABLE_LOW <= magic <= SKIPPABLE_HIGH:
            if at + 8 + length > len(view):
                raise ValueError("the archive ends inside a skippable frame")
            if at == 0 and magic == DICTIONARY_MAGIC:
                raw = bytes(view[8 : 8 + length])
                if raw[:4] == struct.pack("<I", FRAME_MAGIC):
                    raw = zstandard.ZstdDecompressor().decompress(raw)
                dictionary = zstandard.ZstdCompressionDict(raw) if raw else None
            at += 8 + length
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"no frame at byte {at}")
        one = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        parts = []
        while not one.eof:
            if at >= len(view):
                raise ValueError("the archive ends inside a frame")
            fed = view[at : at + _CHUNK]
            parts.append(one.decompress(fed))
            at += len(fed) - len(one.unused_data)
        yield b"".join(parts)


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary for such records; of too few samples, their bytes as they are."""
    if sum(map(len, samples)) > 4 * DICTIONARY_BYTES and len(samples) >= 16:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    return b"".join(samples)[:DICTIONARY_BYTES]


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> None:
    """The pages as archives under ``path``, one or more for each partition."""
    spark = pages.sparkSession
    common.lean(spark)
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    sample = common.sample(base.select("id", "url", F.substring("payload", 1, SAMPLE_BYTES).alias("payload")), SAMPLE_PAGES, ["id", "url"], 3).collect()
    dictionary = spark.sparkContext.broadcast(train_dictionary([record(r["id"], r["url"], bytes(r["payload"]), None) for r in sample]))

    keyed = base.withColumn("sha", F.unhex(F.sha1("payload")))
    shared = keyed.where(F.octet_length("payload") >= least).groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where("n > 1 and first is not null")
    shared = common.cut(shared)
    often = shared.where(F.col("n") * COMMON >= F.lit(base.count())).select("sha", F.col("first").alias("often"))
    # pages with a common payload take its first page by broadcast, of COMMON rows at most, and are dealt by their own hash
    marked = keyed.join(F.broadcast(often), "sha", "left").withColumn("key", F.when(F.col("often").isNull(), F.col("sha")).otherwise(F.unhex(F.sha1(F.concat(F.lit("often"), F.xxhash64("id", "url").cast("string"))))))
    rare = shared.join(F.broadcast(often), "sha", "left_anti").select(F.col("sha").alias("key"), "first")
    marked = marked.join(rare, "key", "left").withColumn("first", F.coalesce("often", "first"))
    marked = marked.select("id", "url", "payload", F.when(F.col("id").isNull() | (F.col("first") != F.col("id")), F.col("first")).alias("refers"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = dictionary.value
        packer = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
        head = dictionary_frame(raw)
        archive, place, size = 0, 0, 0
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                rows = []
                for r in batch.slice(a, 256).to_pylist():
                    if size >= ARCHIVE_BYTES:
                        archive, place, size = archive + 1, 0, 0
                    if not place:
                        rows.append((archive, 0, head))
                    rows.append((archive, place + 1, packer.compress(record(r["id"], r["url"], r["payload"], r["refers"]))))
                    place += 1
                    size += len(rows[-1][2])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["archive", "place", "frame"])

    lines = marked.mapInArrow(common.tidy(write), "archive int, place long, frame binary").sortWithinPartitions("archive", "place")
    lines.select("archive", F.col("frame").cast("string").alias("value")).write.partitionBy("archive").option("lineSep", SEPARATOR.decode()).text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row a record: record_id, record_type, url, refers_to, payload_bytes, payload_digest [, payload]."""
    names = ["record_id", "record_type", "url", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * payloads

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for frame in frames(content.as_py()):
                    headers, block = parse(frame)
                    if headers["warc-type"] not in ("response", "revisit"):
                        continue
                    length, payload = http_payload(headers, block)
                    refers = headers.get("warc-refers-to")
                    rows.append((headers["warc-record-id"], headers["warc-type"], headers.get("warc-target-uri"), refers, length, headers.get("warc-payload-digest", "").removeprefix("sha1:"), payload)[: len(names)])
                    if len(rows) == 256:
                        yield _rows(rows, names)
                        rows = []
                yield _rows(rows, names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content")
    return files.mapInArrow(common.tidy(read), "record_id string, record_type string, url string, refers_to string, payload_bytes long, payload_digest string" + ", payload binary" * payloads)


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_folder(spark, "archives")
    write_archives(common.table(spark, sf_dir, "pages"), path)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, 'page:([-0-9]+)', 1) AS BIGINT)")
    read = read_archives(spark, path)
    return read.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("refers_to").isNotNull(), number("refers_to")).alias("refers_to"))
