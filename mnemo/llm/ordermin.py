"""Document fingerprints by order MinHash: minimal occurrence-numbered k-mers in the order of the text.

A k-mer is K code points in a row, numbered by its earlier occurrences in the text, so that repeats
count. For each of SLOTS hash functions the PICKED k-mers of smallest hash are put back into the
order in which they stand in the text, and the hash of that tuple is one slot of the signature. Two
texts agree in a slot if they share the minimal k-mers and their order, so the share of equal slots
falls with the edits between them, moved passages included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemo.llm.common import sliced

K, PICKED, SLOTS = 8, 2, 64
STRIDE = 4096


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEEDS = mixed(np.arange(1, 2 * SLOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_XOR, _ODD = (_SEEDS[:SLOTS] >> np.uint64(32)).astype(np.uint32)[:, None], (_SEEDS[SLOTS:] >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)
_BASE = 0x9E3779B97F4A7C15 | 1


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def kmers(points: np.ndarray, k: int = K) -> np.ndarray:
    """A 64-bit hash of each k code points in a row. A shorter text is one k-mer, the empty one has none."""
    k = min(k, len(points))
    if not k:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(len(points) - k + 1, dtype=np.uint64)
    for j in range(k):
        out *= np.uint64(_BASE)
        out += points[j : j + len(out)]
    return mixed(out)


def numbered(hashes: np.ndarray) -> np.ndarray:
    """Each k-mer's hash with the number of its earlier occurrences worked in.

    Places are sorted along with the upper bits of the hashes, 44 of them for a text of a million.
    """
    n = len(hashes)
    place = np.uint64((1 << n.bit_length()) - 1)
    ranked = np.sort((hashes & ~place) | np.arange(n, dtype=np.uint64))
    upper = ranked | place
    new = np.ones(n, dtype=bool)
    new[1:] = upper[1:] != upper[:-1]
    again = np.flatnonzero(~new)
    if not len(again):
        return hashes
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))[again]
    out, at = hashes.copy(), (ranked[again] & place).astype(np.int64)
    out[at] = mixed(out[at] + (again - first).astype(np.uint64) * np.uint64(_BASE))
    return out


_TABLE = np.empty(SLOTS * STRIDE, dtype=np.uint32)
_ROW = np.arange(SLOTS)
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def minima(items: np.ndarray, start: int = 0) -> np.ndarray:
    """For every hash function the smallest of ``items``, which stand at ``start`` and on: (SLOTS, PICKED).

    A minimum is its hash in the upper and its place in the lower half, so of equal hashes the earlier
    k-mer is taken. Functions are bijections of the folded hash of a k-mer. The work array is STRIDE
    wide, whatever the text.
    """
    found = [np.full((SLOTS, PICKED), NONE)]
    folded = (items ^ (items >> np.uint64(32))).astype(np.uint32)
    for a in range(0, len(items), STRIDE):
        some = folded[a : a + STRIDE]
        table = _TABLE[: SLOTS * len(some)].reshape(SLOTS, len(some))
        np.bitwise_xor(some, _XOR, out=table)
        np.multiply(table, _ODD, out=table)
        for _ in range(min(PICKED, len(some))):
            at = table.argmin(axis=1)
            found.append(((table[_ROW, at].astype(np.uint64) << np.uint64(32)) | (at + (start + a)).astype(np.uint64))[:, None])
            table[_ROW, at] = 0xFFFFFFFF
    return np.sort(np.concatenate(found, axis=1), axis=1)[:, :PICKED]


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sort(np.concatenate((a, b), axis=1), axis=1)[:, :PICKED]


def signature(best: np.ndarray, items: np.ndarray) -> np.ndarray:
    """One 32-bit hash a slot, of the picked k-mers in the order of the text."""
    places = np.sort(np.where(best == NONE, len(items), best & np.uint64(0xFFFFFFFF)).astype(np.int64), axis=1)
    picked = np.append(items, np.uint64(0))[places]
    out = np.zeros(SLOTS, dtype=np.uint64)
    for p in range(PICKED):
        out = mixed(out * np.uint64(_BASE) + picked[:, p] + np.uint64(1))
    return (out >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def shown(slots: np.ndarray) -> str:
    return slots.astype(">u4").tobytes().hex()


@dataclass
class Print:
    """A text with what its edited form needs again: minima of the part that stays."""

    text: str
    slots: np.ndarray
    kept: np.ndarray
    n_kept: int


def fingerprint(text: str) -> np.ndarray:
    items = numbered(kmers(code_points(text)))
    return signature(minima(items), items)


def printed(text: str) -> Print:
    """The fingerprint of a text, in two parts: k-mers inside the first two thirds, and the others."""
    items = numbered(kmers(code_points(text)))
    n_kept = max(0, len(text) - len(text) // 3 - K + 1) if len(text) >= K else 0
    kept = minima(items[:n_kept])
    return Print(text, signature(merged(kept, minima(items[n_kept:], n_kept)), items), kept, n_kept)


def edited(of: Print, following: str) -> tuple[str, np.ndarray]:
    """The text with its last third replaced by as much of the following one, and that text's fingerprint."""
    tail = len(of.text) // 3
    text = of.text[: len(of.text) - tail] + following[:tail]
    if len(text) < K:
        return text, fingerprint(text)
    items = numbered(kmers(code_points(text)))
    return text, signature(merged(of.kept, minima(items[of.n_kept :], of.n_kept)), items)


OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of rows (bucket, lent, doc_id, text) sorted by bucket, own rows before lent ones.

    A row is finished once the next one of its bucket is read: the first lent row ends the bucket.
    """
    bucket, before, doc = None, None, None
    for batch in sliced(batches, 64):
        rows = []
        for b, lent, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            if b != bucket:
                bucket, before = b, None
            elif lent and before is None:
                continue
            now = printed(text.as_py() or "")
            if before is not None:
                made, slots = edited(before, now.text)
                rows.append((doc, len(before.text), hashlib.sha256(made.encode("utf-8", "surrogatepass")).hexdigest(), shown(before.slots), shown(slots), likeness(before.slots, slots), likeness(before.slots, now.slots)))
            before, doc = (None if lent else now), doc_id
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(OUT), OUT.types, strict=True)], schema=OUT)


def bucket_of(doc_id: Column, bounds: list[int]) -> Column:
    """The number of bounds that are not above ``doc_id``, by binary search; 0 without doc_id."""
    if not bounds:
        return F.lit(0)
    held = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    search = F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(F.coalesce(F.get(held, at + step - 1) <= doc_id, F.lit(False)), at + step).otherwise(at))
    return F.when(doc_id.isNull(), 0).otherwise(search)


def bounds_of(ids: DataFrame, buckets: int) -> list[int]:
    """Identifiers that cut the table into about equal ranges: as many as there are partitions to fill."""
    found = ids.agg(F.percentile_approx("doc_id", [k / buckets for k in range(1, buckets)], 10 * buckets)).first()[0] if buckets > 1 else None
    return sorted(set(found or []))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: the fingerprints of its text and of its edited text, and how near they are.

    The edited text takes its end from the next row by descending doc_id (rows without doc_id last, rows
    of one doc_id by text, the last row is followed by the first). Null text counts as empty; the empty
    text has a fingerprint of its own, equal to that of other empty texts only; a text of fewer than K
    code points is one k-mer. An empty table gives an empty result; other columns are ignored.

    Texts are moved once, into ranges of doc_id; a range also gets the first row of the next lower one.
    Rows that share a doc_id, or have none, are in one range, read as a stream. Memory is some 100
    bytes a code point of the longest text, whatever the rows.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bounds = bounds_of(rows.select("doc_id"), 4 * partitions)
    bucket = bucket_of(F.col("doc_id"), bounds)
    heads = rows.select(bucket.alias("bucket"), "doc_id").groupBy("bucket").agg(F.max("doc_id").alias("head"))
    found = sorted((r["bucket"], r["head"]) for r in heads.collect())  # one row a range
    above = {b: found[(k + 1) % len(found)][0] for k, (b, _) in enumerate(found)}
    lend = spark.createDataFrame([(b, head, above[b]) for b, head in found], "bucket int, head long, above int")
    with_heads = rows.withColumn("bucket", bucket).join(F.broadcast(lend), "bucket")
    is_head = F.col("doc_id").eqNullSafe(F.col("head"))
    places = F.when(is_head, F.array(F.struct(F.col("bucket"), F.lit(False).alias("lent")), F.struct(F.col("above").alias("bucket"), F.lit(True).alias("lent")))).otherwise(F.array(F.struct(F.col("bucket"), F.lit(False).alias("lent"))))
    moved = with_heads.select(F.explode(places).alias("_at"), "doc_id", "text").select("_at.bucket", "_at.lent", "doc_id", "text")
    laid = moved.repartition(partitions, "bucket").sortWithinPartitions("bucket", "lent", F.desc_nulls_last("doc_id"), F.asc_nulls_first(F.coalesce("text", F.lit(""))))
    return laid.mapInArrow(in_order, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
