"""Zstandard WARC archives: a dictionary in a leading skippable frame, then one frame per record."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemo.llm.common import join_small, new_path, sliced, written
from mnemo.llm.files import reading, replacing

SKIPPABLE = 0x184D2A5D
FRAME = struct.pack("<I", 0xFD2FB528)
DICTIONARY = struct.pack("<I", 0xEC30A437)
CONTROL = re.compile(r"[\x00-\x20\x7f]")
TASK_BYTES = 64 << 20
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


class ArchiveError(ValueError):
    """An archive that breaks the format: which file, where, and how."""


def train_dictionary(samples: list[bytes], size: int = 16384) -> bytes:
    """A dictionary of at most ``size`` bytes; where too little is there to train on, the samples' start."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    if data[:4] == FRAME:
        data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    if len(data) < 8:
        return None
    kind = zstandard.DICT_TYPE_FULLDICT if data[:4] == DICTIONARY else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(data, dict_type=kind)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC record. A revisit has no body; it names the digest and length of the full payload."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {size}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + CONTROL.sub(lambda m: f"%{ord(m.group()):02X}", url))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + payload + b"\r\n\r\n"


def parse_record(data: bytes, where: str) -> tuple:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload), checked."""
    cut = data.find(b"\r\n\r\n")
    if cut < 0 or not data.startswith(b"WARC/1."):
        raise ArchiveError(f"{where}: no WARC header")
    fields = {}
    for line in data[:cut].decode("utf-8", "surrogatepass").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ArchiveError(f"{where}: header line without a colon")
        fields[name.strip().lower()] = value.strip()
    body = data[cut + 4 :]
    try:
        length, size = int(fields["content-length"]), int(fields["warc-payload-length"])
        kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
        ident = fields["warc-record-id"].removeprefix("<urn:page:").removesuffix(">")
        refers = fields.get("warc-refers-to")
    except (KeyError, ValueError) as e:
        raise ArchiveError(f"{where}: header {e} is missing or malformed") from None
    if len(body) != length + 4 or body[length:] != b"\r\n\r\n":
        raise ArchiveError(f"{where}: Content-Length {length}, but {len(body) - 4} bytes")
    payload = body[:length]
    if kind == "response" and (length != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ArchiveError(f"{where}: payload does not match its digest and length")
    if kind not in ("response", "revisit") or (kind == "revisit") != (refers is not None):
        raise ArchiveError(f"{where}: record type {kind}")
    refers_to = int(refers.removeprefix("<urn:page:").removesuffix(">")) if refers else None
    return int(ident) if ident else None, fields.get("warc-target-uri"), size, digest, kind, refers_to, payload


def read_archive(f, name: str, chunk: int = 1 << 20) -> Iterator[tuple]:
    """Records of one archive, one frame at a time; memory holds one record and one chunk."""
    at, buffer = 0, b""
    dictionary, decompressor = None, zstandard.ZstdDecompressor()
    first = True
    while True:
        while len(buffer) < 8:
            more = f.read(chunk)
            if not more:
                break
            buffer += more
        if not buffer:
            return
        if len(buffer) < 8:
            raise ArchiveError(f"{name}: {len(buffer)} stray bytes at {at}")
        magic, length = struct.unpack("<II", buffer[:8])
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            while len(buffer) < 8 + length:
                more = f.read(chunk)
                if not more:
                    raise ArchiveError(f"{name}: skippable frame cut short at {at}")
                buffer += more
            if magic == SKIPPABLE and first:
                dictionary = _dictionary(buffer[8 : 8 + length])
                decompressor = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else decompressor
            buffer, at, first = buffer[8 + length :], at + 8 + length, False
            continue
        first = False
        one, parts, used = decompressor.decompressobj(), [], 0
        while True:
            try:
                parts.append(one.decompress(buffer))
            except zstandard.ZstdError as e:
                raise ArchiveError(f"{name}: frame at {at}: {e}") from None
            used += len(buffer)
            if one.eof:
                break
            buffer = f.read(chunk)
            if not buffer:
                raise ArchiveError(f"{name}: frame cut short at {at}")
        buffer = one.unused_data
        yield parse_record(b"".join(parts), f"{name}: frame at {at}")
        at += used - len(buffer)


def write_archives(pages: DataFrame, folder: str, least_revisit: int = 1000, samples: int = 256, roll_bytes: int = 64 << 20) -> DataFrame:
    """Write every row of (page_id, url, html) as a record; returns the manifest (file, records).

    Of records with equal payloads of at least ``least_revisit`` bytes, the one with the largest
    page_id is a response and the others revisit it. The dictionary is trained on the first 8,000
    characters of about ``samples`` pages, chosen by hash; it changes sizes only. A task that runs again replaces its files.
    """
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    groups = rows.where(F.col("size") >= least_revisit).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = written(groups.select("digest", "keeper"), "warc-repeated")
    rows = join_small(rows, repeated, "digest", "left", spread="page_id").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")))
    share = int(min(1.0, samples / max(1, pages.count())) * (1 << 30))
    pick = F.pmod(F.xxhash64("page_id", "url", F.octet_length("html"), F.lit(3)), F.lit(1 << 30))
    sampled = pages.where(pick < share).select(F.substring("html", 1, 8000).alias("html")).where("html <> ''").limit(4 * samples).collect()
    dictionary = train_dictionary(sorted(r["html"].encode("utf-8", "surrogatepass") for r in sampled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = _dictionary(dictionary)
        compressor = zstandard.ZstdCompressor(level=3, dict_data=loaded, write_checksum=True) if loaded else zstandard.ZstdCompressor(level=3, write_checksum=True)
        part, number = TaskContext.get().partitionId(), 0

        def records() -> Iterator[bytes]:
            for batch in sliced(batches):
                for row in zip(*(batch.column(i) for i in range(6)), strict=True):
                    page_id, url, data, digest, size, refers_to = (x.as_py() for x in row)
                    yield compressor.compress(record_bytes(page_id, url, data, digest, size, refers_to))

        source = records()
        frame = next(source, None)
        while frame is not None:
            name, n, size = f"part-{part:06d}-{number:04d}.warc.zst", 0, 0
            with replacing(f"{folder}/{name}") as out:
                out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
                while frame is not None and size < roll_bytes:
                    out.write(frame)
                    n, size = n + 1, size + len(frame)
                    frame = next(source, None)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file", "records"])
            number += 1

    return written(rows.select("page_id", "url", "payload", "digest", "size", "refers_to").mapInArrow(run, "file string, records long"), "warc-manifest")


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of every ``*.warc.zst`` archive in the folder, validated. Archives are read in parallel."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "length")
    # the rows are a few names, so Spark can't tell how much work they are: a task an archive, or so
    n_files, n_bytes = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = min(max(1, n_files), max(spark.sparkContext.defaultParallelism, n_bytes // TASK_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with reading(path) as f:
                    held, size = [], 0
                    for record in read_archive(f, path):
                        held.append(record if payloads else (*record[:6], None))
                        size += len(record[6])
                        if len(held) == 256 or (payloads and size > 8 << 20):
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    return files.select("path").repartition(int(tasks)).mapInArrow(run, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, by way of archives.

    Null html is an empty payload; a null url is left out of its record; repeated rows are a record
    each, and those with the group's largest page_id are all responses; an empty table gives an empty
    result.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    manifest = write_archives(pages, folder)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    if manifest.isEmpty():
        return spark.createDataFrame([], RECORD).select(*columns)
    return read_archives(spark, folder, payloads=False).select(*columns)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) :: BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM k
"""
