"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations, then verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.llm.common import join_small, written
from mnemo.llm.graph import components

TABLES = 10
PROBES = 4
BLOCK = 512
BIN = 4096


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width = x.shape
    half = 1
    while half < width:
        x = x.reshape(n, width // (2 * half), 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        half *= 2
    return x.reshape(n, width) / math.sqrt(width)


def tables_for(functions: int) -> int:
    """Tables by functions per table. A function more cuts a table's hits at cosine 0.95 to about two thirds in 768
    dimensions (less in fewer), so tables grow by 1.6: recall stays above 0.95 however large the input is (a test)."""
    return math.ceil(TABLES * 1.6 ** max(0, functions - 3))


def bucket_keys(unit: np.ndarray, functions: int, tables: int = TABLES, probes: int = PROBES, seed: int = 9) -> np.ndarray:
    """(n, tables * probes) 64-bit bucket keys. A table concatenates ``functions`` cross-polytope
    hashes; its further probes replace the least certain ones by their runners-up."""
    n, dim = unit.shape
    width = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :dim] = unit
    rng = np.random.default_rng(seed)
    out = np.empty((n, tables * probes), dtype=np.int64)
    rows = np.arange(n)
    for t in range(tables):
        best, second, margin = [], [], []
        for _ in range(functions):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width))
            size = np.abs(y)
            top = np.argpartition(size, -2, axis=1)[:, -2:]
            order = np.take_along_axis(size, top, 1).argsort(axis=1)
            first, other = top[rows, order[:, 1]], top[rows, order[:, 0]]
            best.append(2 * first + (y[rows, first] < 0))
            second.append(2 * other + (y[rows, other] < 0))
            margin.append(size[rows, first] - size[rows, other])
        best, second, margin = np.array(best), np.array(second), np.array(margin)
        doubtful = margin.argsort(axis=0)
        # probe p swaps the functions named by its bits, least certain first: 1, 2, 1+2, 3, ...
        for p in range(probes):
            code = np.full(n, t + 1, dtype=np.uint64)
            used = best.copy()
            for bit in range(functions):
                if p >> bit & 1:
                    used[doubtful[bit], rows] = second[doubtful[bit], rows]
            for f in range(functions):
                code = (code * np.uint64(0x9E3779B97F4A7C15)) ^ (used[f].astype(np.uint64) + np.uint64(1))
                code ^= code >> np.uint64(29)
            code *= np.uint64(0xBF58476D1CE4E5B9)
            code = (code & np.uint64(~0xFF & (2**64 - 1))) | np.uint64(t)
            out[:, t * probes + p] = code.view(np.int64)
    return out


def sketches(unit: np.ndarray, seed: int = 10) -> np.ndarray:
    """(n, 2) words of 128 bits: on which side of random hyperplanes a vector lies."""
    planes = np.random.default_rng(seed).normal(size=(unit.shape[1], 128))
    return np.packbits(unit @ planes > 0, axis=1).view(np.int64)


def most_apart(threshold: float) -> int:
    """Sketch bits in which two vectors of this cosine differ at most, seven standard deviations above their mean."""
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    return math.ceil(128 * p + 7 * math.sqrt(128 * p * (1 - p)))


def worth_comparing(pdf: pd.DataFrame, apart: int) -> pd.DataFrame:
    """Those members of small buckets that have another of their bucket near by their sketches."""
    pdf = pdf.sort_values("key", kind="stable")
    key, one, two = pdf["key"].to_numpy(), *(pdf[c].to_numpy().view(np.uint64) for c in ("s1", "s2"))  # counts of signed words leave out the sign
    near = np.zeros(len(pdf), dtype=bool)
    for a, b in _same_bucket(key):
        close = np.bitwise_count(one[a] ^ one[b]).astype(np.int64) + np.bitwise_count(two[a] ^ two[b]) <= apart
        near[a[close]] = near[b[close]] = True
    return pdf.loc[near, ["rep", "key"]]


def clean_vectors(df: DataFrame) -> DataFrame:
    """(vec_id, digest, dim, unit): digest is null for a vector that links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, units, dims = [], [], []
            for value in batch.column(1):
                unit = None
                if value.is_valid and len(value.values) and not value.values.null_count:
                    v = value.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    top = np.abs(v).max()
                    if np.isfinite(v).all() and top > 0:
                        scaled = v / top
                        unit = scaled / math.sqrt(float(scaled @ scaled))
                digests.append(None if unit is None else xxhash.xxh3_128_hexdigest((v + 0.0).tobytes()))
                units.append(None if unit is None else unit.tobytes())
                dims.append(0 if unit is None else len(unit))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string()), pa.array(dims, pa.int32()), pa.array(units, pa.binary())], names=["vec_id", "digest", "dim", "unit"])

    return df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, digest string, dim int, unit binary")


def _forest(a: np.ndarray, b: np.ndarray, parent: dict[int, int]) -> list[tuple[int, int]]:
    """Those links that join parts not joined yet, so that a dense group sends on one link a vector."""

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
    return out


def _same_bucket(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of positions of sorted ``keys`` that share a key, by growing distance."""
    at, step = np.arange(len(keys) - 1), 1
    while len(at):
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        if len(at):
            yield at, at + step
        step += 1


def _cross(rows: np.ndarray, cols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for r in rows:
        yield np.full(len(cols), r), cols


def _close(unit: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    c = np.einsum("ij,ij->i", unit[a], unit[b])
    for k in np.flatnonzero(np.abs(c - threshold) < 1e-9):
        c[k] = math.fsum(p * q for p, q in zip(unit[a[k]].tolist(), unit[b[k]].tolist(), strict=True))
    return c >= threshold - 1e-15


def compare_bin(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links within the buckets of one bin, or between the two blocks of a large bucket.

    A pair that shares several buckets counts in the smallest of them only. Rows out: (a, b, 0) for
    a spanning forest of the links, (a, null, n) for n links of a.
    """
    pdf = pdf.sort_values(["key", "rep"], kind="stable")
    left, right = pdf["i"].iloc[0], pdf["j"].iloc[0]
    unit = np.frombuffer(b"".join(pdf["unit"]), dtype=np.float64).reshape(len(pdf), -1)
    ids, key, block, mult = (pdf[c].to_numpy() for c in ("rep", "key", "block", "mult"))
    keys = np.stack(pdf["keys"].to_numpy())
    pairs = _same_bucket(key) if left == right else _cross(np.flatnonzero(block == left), np.flatnonzero(block == right))
    counts = np.zeros(len(pdf), dtype=np.int64)
    edges: list[tuple[int, int]] = []
    parent: dict[int, int] = {}

    def settle(held_a: list[np.ndarray], held_b: list[np.ndarray]) -> None:
        a, b = np.concatenate(held_a), np.concatenate(held_b)
        near = _close(unit, a, b, threshold)
        a, b = a[near], b[near]
        for at in range(0, len(a), 8192):
            x, y = a[at : at + 8192], b[at : at + 8192]
            ka, kb = keys[x], keys[y]
            least = np.full(len(x), np.iinfo(np.int64).max)
            for k in range(ka.shape[1]):
                shared = (ka[:, k : k + 1] == kb).any(axis=1)
                least = np.where(shared, np.minimum(least, ka[:, k]), least)
            first = least == key[x]
            np.add.at(counts, x[first], mult[y[first]])
            np.add.at(counts, y[first], mult[x[first]])
        edges.extend(_forest(ids[a], ids[b], parent))

    held_a, held_b, size = [], [], 0
    for a, b in pairs:
        held_a.append(a)
        held_b.append(b)
        size += len(a)
        if size > 65536:
            settle(held_a, held_b)
            held_a, held_b, size = [], [], 0
    if size:
        settle(held_a, held_b)
    some = np.flatnonzero(counts)
    return pd.DataFrame(
        {
            "a": pd.array([e[0] for e in edges] + ids[some].tolist(), dtype="Int64"),
            "b": pd.array([e[1] for e in edges] + [None] * len(some), dtype="Int64"),
            "links": pd.array([0] * len(edges) + counts[some].tolist(), dtype="Int64"),
        }
    )


def near_duplicates(df: DataFrame, threshold: float = 0.95, tables: int | None = None, probes: int = PROBES) -> DataFrame:
    """vec_id, n_links, component_id, kept for every vector, by cosine at least ``threshold``.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing;
    vectors of different dimensions never link. Equal vectors are one class with a multiplicity, so
    copies are counted without being paired. Buckets of over BLOCK members are compared in pairs of
    blocks, each its own task's work, all of it: nothing is capped. Hash functions per table grow
    with the logarithm of the table, which keeps buckets small, and tables with them. Rows that repeat a vec_id are one
    vector each; an empty table gives an empty result.
    """
    rows = written(clean_vectors(df), "vec-clean")
    classes = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("mult"), F.first("unit").alias("unit"), F.first("dim").alias("dim"))
    reps = written(classes.withColumn("rep", F.monotonically_increasing_id()), "vec-classes")
    n, dim = reps.agg(F.count(F.lit(1)), F.coalesce(F.max("dim"), F.lit(2))).first()
    functions = max(3, math.ceil(math.log(max(4 * n, 2)) / math.log(2 * max(2, dim))))
    tables = tables or tables_for(functions)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array(batch.column(2).to_pylist(), dtype=np.int64)
            keys = np.zeros((batch.num_rows, tables * probes), dtype=np.int64)
            bits = np.zeros((batch.num_rows, 2), dtype=np.int64)
            raw = batch.column(3).to_pylist()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                for k in range(0, len(at), 2048):
                    part = at[k : k + 2048]
                    unit = np.frombuffer(b"".join(raw[i] for i in part), dtype=np.float64).reshape(len(part), -1)
                    bits[part] = sketches(unit)
                    keys[part] = bucket_keys(unit, functions, tables, probes) ^ (np.int64(d) << np.int64(40))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat, batch.column(3), pa.array(bits[:, 0]), pa.array(bits[:, 1])], names=["rep", "mult", "keys", "unit", "s1", "s2"])

    coded = written(reps.select("rep", "mult", "dim", "unit").mapInArrow(hashed, "rep long, mult long, keys array<long>, unit binary, s1 long, s2 long"), "vec-keys")
    members = coded.select("rep", "s1", "s2", F.explode(F.array_distinct("keys")).alias("key"))
    buckets = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    hits = written(members.join(buckets, "key").select("rep", "key", "s1", "s2", F.ceil(F.col("n") / BLOCK).alias("blocks")), "vec-buckets")
    # vectors and keys are sent only for hits that narrow sketches leave; 16 bytes a hit settle most
    few = hits.where("blocks = 1")
    bins = 1 + few.count() // (4 * BIN)
    apart = most_apart(threshold)
    few = few.withColumn("bin", F.pmod(F.xxhash64("key"), F.lit(bins))).groupBy("bin").applyInPandas(lambda pdf: worth_comparing(pdf, apart), "rep long, key long")
    few = written(few, "vec-near")
    bins = 1 + few.count() // BIN
    small = few.select("rep", "key", F.pmod(F.xxhash64("key"), F.lit(bins)).alias("bin"), *[F.lit(0).cast("long").alias(c) for c in ("block", "i", "j")])
    placed = hits.where("blocks > 1").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    large = placed.select("rep", "key", F.col("key").alias("bin"), "block", (F.least("block", "other") + 1).alias("i"), (F.greatest("block", "other") + 1).alias("j")).withColumn("block", F.col("block") + 1)
    work = small.unionByName(large).join(coded.drop("s1", "s2"), "rep").withColumn("width", F.octet_length("unit"))
    out = written(work.groupBy("bin", "i", "j", "width").applyInPandas(lambda pdf: compare_bin(pdf, threshold), "a long, b long, links long"), "vec-links")
    links = out.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("_links"))
    parts = written(components(out.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "rep").join(reps.select("rep", "least"), "rep"), "vec-parts")
    lowest = parts.groupBy("component").agg(F.min("least").alias("lowest"))
    parts = parts.join(lowest, "component").select("rep", "lowest")
    verdict = written(
        reps.select("digest", "rep", "least", "mult").join(links, "rep", "left").join(parts, "rep", "left")
        .select("digest", (F.coalesce("_links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("lowest", "least").alias("component_id"))
        .where("n_links > 0"),
        "vec-verdicts",
    )
    narrow = rows.select("vec_id", "digest")
    return join_small(narrow, verdict, "digest", "left", spread="vec_id").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.coalesce("component_id", "vec_id") == F.col("vec_id")).alias("kept"),
    )


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding :: DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
ok AS (SELECT * FROM u WHERE norm > 0 AND isfinite(norm) AND NOT list_contains(list_transform(e, lambda x: x IS NULL), true)),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM pairs GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0) :: BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN comp c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
