"""A stored vector index: an inverted file of cells around sampled centroids, with statistics a filter can prune by.

``build`` learns centroids on a bounded sample, deals every vector to its nearest one and writes cells
as partitions. ``search`` reads the cells nearest to a probe and ranks by exact distances; with
``exact`` it goes on to every cell that the triangle inequality can't rule out, so that its result is that
of search.batch_top_k. A cell's statistics are its size, its radius as an angle, and the least and
largest value of each filter field.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mnemo.operators import search
from mnemo.sources.shared import shared_path

CELL_ROWS, MOST_CELLS, SAMPLE_ROWS, ROUNDS = 2000, 16_384, 131_072, 8
PROBES = 8


def train(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit centroids of a sample of unit vectors: Lloyd's rounds by cosine from random rows of the sample."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        nearest = np.concatenate([(sample[a : a + 4096] @ centres.T).argmax(axis=1) for a in range(0, len(sample), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return centres


def assigned(df: DataFrame, centres: np.ndarray, id_col: str, vector_col: str, fields: Sequence[str]) -> DataFrame:
    """(id, vector, fields, cell, angle): the nearest centroid of each vector; zero and null vectors are left out."""
    shared = df.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v = search._units(pdf[vector_col])
            ok = ~np.isnan(v).any(axis=1)
            c = v[ok] @ shared.value.T
            cell = c.argmax(axis=1)
            yield pdf[ok].assign(cell=cell.astype("int32"), angle=np.arccos(np.clip(c[np.arange(len(c)), cell], -1, 1)))

    rows = df.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).select(id_col, vector_col, *fields)
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInPandas(run, f"{kinds}, cell int, angle double") if len(centres) else rows.limit(0).selectExpr("*", "0 AS cell", "0.0D AS angle")


@dataclass
class VectorIndex:
    """An index below ``path``: ``centres`` (a row a cell, with statistics) and ``cells`` (its vectors)."""

    spark: SparkSession
    path: str
    id_col: str
    vector_col: str
    fields: tuple[str, ...]
    shape: StructType
    stats: StructType

    @property
    def centres(self) -> DataFrame:
        return self.spark.read.schema(self.stats).parquet(f"{self.path}/centres")

    def rows(self, cells: Sequence[int] | None = None) -> DataFrame:
        """Vectors of the named cells, or all: partition pruning, no other file is opened."""
        found = self.spark.read.schema(self.shape).parquet(f"{self.path}/cells")
        return found if cells is None else found.where(F.col("cell").isin([int(c) for c in cells]))


def build(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", fields: Sequence[str] = (), path: str | None = None, cells: int | None = None, sample_rows: int = SAMPLE_ROWS) -> VectorIndex:
    """Write an index of all rows of ``df`` that have a vector.

    Centroids are learnt on at most ``sample_rows`` rows (a hash of the identifier chooses them, so reruns
    agree) and are at most MOST_CELLS. A cell with many rows is many files.
    """
    spark = df.sparkSession
    path = path or shared_path(spark, "vector-index")
    n = df.where(F.col(vector_col).isNotNull()).count()
    cells = cells or min(MOST_CELLS, max(1, n // CELL_ROWS))
    share = min(1.0, sample_rows / max(1, n))
    chosen = df.where(F.col(vector_col).isNotNull() & (F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int(share * (1 << 30)))).select(id_col, vector_col)
    picked = chosen.orderBy(F.xxhash64(id_col)).limit(sample_rows).toPandas()  # a hash's share may go over the bound
    units = search._units(picked[vector_col]) if len(picked) else np.empty((0, 1))
    units = units[~np.isnan(units).any(axis=1)]
    centres = train(units, cells) if len(units) else units
    rows = assigned(df, centres, id_col, vector_col, fields)
    salted = rows.repartition(F.col("cell"), F.pmod(F.xxhash64(id_col), F.lit(max(1, n // (cells * 8 * CELL_ROWS)))))
    salted.sortWithinPartitions("cell", *fields).write.option("maxRecordsPerFile", 1 << 20).partitionBy("cell").parquet(f"{path}/cells")
    written = spark.read.schema(rows.schema).parquet(f"{path}/cells")
    stats = written.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius"), *[f(c).alias(f"{c}_{name}") for c in fields for f, name in ((F.min, "min"), (F.max, "max"))])
    known = spark.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(centres)], "cell int, centre array<double>")
    told = known.join(stats, "cell")
    told.coalesce(1).write.parquet(f"{path}/centres")
    return VectorIndex(spark, path, id_col, vector_col, tuple(fields), rows.schema, told.schema)


def reach(index: VectorIndex, queries: DataFrame, cells: DataFrame) -> DataFrame:
    """(id, cell, at, near): every cell in the order of its distance from a probe, and the least angle a member can have."""
    held = cells.select("cell", "centre", "radius").orderBy("cell").toPandas()  # at most MOST_CELLS rows
    shared = index.spark.sparkContext.broadcast((held["cell"].to_numpy(), search._units(held["centre"]) if len(held) else None, held["radius"].to_numpy(dtype=float)))
    kind = dict(queries.dtypes)[index.id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, centre, radius = shared.value
        for pdf in batches:
            if centre is None:
                continue
            angle = np.arccos(np.clip(search._units(pdf["v"]) @ centre.T, -1, 1))
            angle[np.isnan(angle)] = np.pi
            at = angle.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")
            yield pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy(), len(cell)), "cell": np.tile(cell, len(pdf)), "at": at.ravel(), "near": np.maximum(angle - radius, 0).ravel()})

    return queries.select(F.col(index.id_col).alias("id"), F.col(index.vector_col).alias("v")).mapInPandas(run, f"id {kind}, cell int, at long, near double")


def _probed(index: VectorIndex, queries: DataFrame, pairs: DataFrame, k: int, where: Column | None) -> DataFrame:
    """Each probe's k nearest rows in the cells that ``pairs`` (id, cell) gives it."""
    cells = [r["cell"] for r in pairs.select("cell").distinct().collect()]  # at most MOST_CELLS
    base = index.rows(cells)
    base = base if where is None else base.where(where)
    asked = queries.select(F.col(index.id_col).alias("id"), F.col(index.vector_col)).join(pairs, "id").select(F.col("id").alias(index.id_col), index.vector_col, F.col("cell").cast("string").alias("cell"))
    return search.batch_top_k(asked, base.withColumn("cell", F.col("cell").cast("string")), k, index.id_col, index.vector_col, by=["cell"])


def top_k(index: VectorIndex, queries: DataFrame, k: int, probes: int = PROBES, where: Column | None = None, may_hold: Callable[[DataFrame], Column] | None = None, exact: bool = False) -> DataFrame:
    """(query_id, id, distance, rank) of the k nearest rows that pass ``where``, from each probe's nearest cells.

    ``may_hold`` is a condition on the statistics (field_min, field_max) of a cell that may have such rows.
    With ``exact``, cells that could hold a row as near as the k-th found, or any row where fewer
    than k were found, are read as well.
    """
    spark = index.spark
    cells = index.centres if may_hold is None else index.centres.where(may_hold(index.centres))
    queries = queries.where(F.col(index.vector_col).isNotNull())
    path = shared_path(spark, "index-probes")
    reach(index, queries, cells).write.parquet(path)
    pairs = spark.read.parquet(path)
    found = _probed(index, queries, pairs.where(F.col("at") < probes).select("id", "cell"), k, where)
    if not exact:
        return found
    # unit vectors at angle a have the distance 1 - cos(a); distances are rounded to nine digits
    worst = found.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("worst"))
    bound = F.acos(F.greatest(F.lit(-1.0), 1 - F.col("worst") - 1e-8)) + 1e-6
    more = pairs.join(worst, "id", "left").where((F.col("at") < probes) | F.col("worst").isNull() | (F.col("near") <= bound)).select("id", "cell")
    return _probed(index, queries, more, k, where)
