"""Token counts of documents in flat token files without an index, by a blockwise separator scan."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemo.llm.common import new_path, running_total, sliced, written
from mnemo.llm.files import reading, replacing

SEPARATOR = 50256
_ENCODERS: dict[str, object] = {}


def byte_encoder(name: str = "byte_bpe_50k.tiktoken"):
    if name not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[name] = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[name]


def write_flat(docs: DataFrame, folder: str, tokenizer: str = "byte_bpe_50k.tiktoken", separator: int = SEPARATOR, dtype: str = "<u2") -> DataFrame:
    """Write one flat token file a task: every document's ids, each followed by the separator.

    Returns the manifest (file, ordinal, doc_id), which the scan does not use. A task that is run
    again writes the same file again, whole.
    """
    end = np.array([separator], dtype=dtype).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(tokenizer)
        name = f"tokens-{TaskContext.get().partitionId():06d}.bin"
        ordinal = 0
        with replacing(f"{folder}/{name}") as out:
            for batch in sliced(batches):
                ids = batch.column(0)
                for text in batch.column(1):
                    out.write(np.array(encoder.encode_ordinary(text.as_py() or ""), dtype=dtype).tobytes() + end)
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(ordinal, ordinal + n)), ids], names=["file", "ordinal", "doc_id"])
                ordinal += n

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(run, "file string, ordinal long, doc_id long"), "flat-manifest")


def scan(spark: SparkSession, folder: str, separator: int = SEPARATOR, dtype: str = "<u2", block_tokens: int = 1 << 20) -> DataFrame:
    """(file, ordinal, start, n_tokens, terminated) of every document in the folder's ``*.bin`` files.

    Files are read in blocks; each block reports its separators' positions. An exclusive prefix scan
    over the blocks of a file, in two levels, gives each block the number of documents before it and
    the last separator before it, which is where its first document began. Counts leave the
    separator out. Tokens after a file's last separator are a document that is not terminated; an
    empty file has none; a trailing part of a token is ignored.
    """
    size = np.dtype(dtype).itemsize
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", F.floor(F.col("length") / size).alias("total"))
    blocks = files.where("total > 0").select("path", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / block_tokens))).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                base = row["block"] * block_tokens
                with reading(row["path"]) as f:
                    data = f.read_at(min(block_tokens, row["total"] - base) * size, base * size)
                at = np.flatnonzero(np.frombuffer(data, dtype=dtype) == separator) + base
                ends = at if base + block_tokens < row["total"] or (len(at) and at[-1] == row["total"] - 1) else np.append(at, row["total"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["path"].rsplit("/", 1)[-1]], pa.string()), pa.array([row["block"]], pa.int64()), pa.array([row["total"]], pa.int64()),
                        pa.array([len(ends)], pa.int64()), pa.array([int(at[-1]) if len(at) else None], pa.int64()), pa.array([ends.tolist()], pa.list_(pa.int64())),
                    ],
                    names=["file", "block", "total", "n_ends", "last_end", "ends"],
                )

    # the rows are a few numbers, so Spark can't tell how much work they are: a task for every few blocks
    n_blocks = files.agg(F.coalesce(F.sum(F.ceil(F.col("total") / block_tokens)), F.lit(0))).first()[0]
    tasks = min(max(1, n_blocks), max(spark.sparkContext.defaultParallelism, n_blocks // 16))
    found = blocks.repartition(int(tasks)).mapInArrow(run, "file string, block long, total long, n_ends long, last_end long, ends array<long>")
    found = written(found.withColumn("_chunk", F.floor(F.col("block") / 256)), "flat-blocks")
    narrow = found.select("file", "block", "_chunk", "n_ends", "last_end")
    counted = running_total(narrow, ["file"], "_chunk", ["block"], "n_ends", "first_ordinal")
    chunks = narrow.groupBy("file", "_chunk").agg(F.max("last_end").alias("_last"))
    over_chunks = Window.partitionBy("file").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("file", "_chunk").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        counted.join(chunks.select("file", "_chunk", F.max("_last").over(over_chunks).alias("_before")), ["file", "_chunk"])
        .withColumn("carry", F.coalesce(F.max("last_end").over(inside), F.col("_before"), F.lit(-1)))
        .select("file", "block", "first_ordinal", "carry")
    )
    starts = F.concat(F.array(F.col("carry") + 1), F.transform(F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0))), lambda e: e + 1))
    rows = found.where("n_ends > 0").join(carried, ["file", "block"]).select(
        "file", "total", "first_ordinal", F.posexplode(F.arrays_zip(starts.alias("start"), F.col("ends").alias("end"))).alias("_k", "_doc")
    )
    return rows.select(
        "file", (F.col("first_ordinal") + F.col("_k")).alias("ordinal"), F.col("_doc.start").alias("start"),
        (F.col("_doc.end") - F.col("_doc.start")).alias("n_tokens"), (F.col("_doc.end") < F.col("total")).alias("terminated"),
    )


def token_counts(docs: DataFrame, **params) -> DataFrame:
    """Token counts of every document, by way of flat files in the shared folder and their scan.

    Null text is empty and counts 0; rows that repeat are counted each; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "flat-tokens")
    manifest = write_flat(docs, folder, **params)
    if manifest.isEmpty():
        return manifest.selectExpr("doc_id", "file", "ordinal", "ordinal AS start", "ordinal AS n_tokens", "true AS terminated")
    return manifest.join(scan(spark, folder), ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens", "terminated")
