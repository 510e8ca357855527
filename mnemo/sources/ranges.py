"""Rows laid out in one sorted order, read page by page from a cursor: a page opens the few files that hold it.

What is written are files that each hold a range of the order, and a list of files with their first and
last key. A cursor is the key of the last row read (keyset paging), so pages stay right when rows
before them come or go, and the cost of a page does not grow with what lies before it or with the
whole of its group.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemo.sources.shared import shared_path

FILE_ROWS = 1 << 20


@dataclass
class SortedRows:
    """``prefix``: columns a page names values of; ``order``: (column, descending) within them, unique together."""

    spark: SparkSession
    path: str
    prefix: tuple[str, ...]
    order: tuple[tuple[str, bool], ...]

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows").drop(*self._keys())

    def _keys(self) -> list[str]:
        return [f"_k{i}" for i in range(len(self.prefix) + len(self.order))]

    def files(self) -> DataFrame:
        """(file, n, lo, hi): a row a file."""
        return self.spark.read.parquet(f"{self.path}/files")


def lay(df: DataFrame, prefix: Sequence[str], order: Sequence[tuple[str, bool]], path: str | None = None, file_rows: int = FILE_ROWS) -> SortedRows:
    """Write ``df`` sorted by prefix and order. Descending columns are numbers; key columns hold no nulls.

    Ranges are cut by the whole key, so one prefix with a third of all rows is many files.
    """
    spark = df.sparkSession
    out = SortedRows(spark, path or shared_path(spark, "ranges"), tuple(prefix), tuple(order))
    values = [F.col(c) for c in prefix] + [-F.col(c) if down else F.col(c) for c, down in order]
    keys = out._keys()
    keyed = df.select("*", *[v.alias(k) for v, k in zip(values, keys, strict=True)])
    keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).write.option("maxRecordsPerFile", file_rows).parquet(f"{out.path}/rows")
    laid = spark.read.parquet(f"{out.path}/rows").select(*keys, F.input_file_name().alias("file"))
    key = F.struct(*keys)
    laid.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).coalesce(1).sortWithinPartitions("lo").write.parquet(f"{out.path}/files")
    return out


def _after(keys: Sequence[Column], values: Sequence, strict: bool = True) -> Column:
    """Whether the key is greater than (or at least) these values, compared column by column."""
    found = F.lit(not strict)
    for k, v in reversed(list(zip(keys, values, strict=False))):
        found = (k > F.lit(v)) | ((k == F.lit(v)) & found)
    return found


def page_files(laid: SortedRows, values: Sequence, size: int, cursor: Sequence | None = None) -> list[str]:
    """The files to open for the next ``size`` rows: the one the cursor is in, and those after it that make up a page."""
    n = len(laid.prefix)
    lo, hi = ([F.col(f"{side}.{k}") for k in laid._keys()] for side in ("lo", "hi"))
    start = [*values, *(cursor or [])]
    ahead = laid.files().where(_after(hi, start, strict=bool(cursor)) & ~_after(lo[:n], values)).orderBy("lo")
    found, rows = [], 0
    for r in ahead.limit(size + 1).toLocalIterator():
        found.append(r["file"])
        rows += r["n"] if len(found) > 1 else 0  # of the first file, any number may lie before the cursor
        if rows >= size:
            break
    return found


def page(laid: SortedRows, values: Sequence, size: int, token: str | None = None, where: Column | None = None) -> tuple[DataFrame, str | None]:
    """(the next ``size`` rows of a prefix that pass ``where``, the token to go on from or null at the end)."""
    keys, n = laid._keys(), len(laid.prefix)
    schema = laid.spark.read.parquet(f"{laid.path}/rows").schema
    cursor = json.loads(token) if token else None
    taken: list = []
    while True:
        files = page_files(laid, values, size, cursor)
        if not files:
            break
        rows = laid.spark.read.schema(schema).parquet(*files)
        for k, v in zip(keys[:n], values, strict=True):
            rows = rows.where(F.col(k) == F.lit(v))
        if cursor:
            rows = rows.where(_after([F.col(k) for k in keys[n:]], cursor))
        held = rows if where is None else rows.where(where)
        taken += held.orderBy(*keys).limit(size - len(taken)).collect()  # a page at most
        if len(taken) >= size:
            break
        last = rows.agg(F.max(F.struct(*keys[n:])).alias("m")).first()["m"]  # all of these files is read: on behind them
        if last is None:
            break
        cursor = list(last)
    out = laid.spark.createDataFrame(taken, schema).drop(*keys)
    done = len(taken) < size
    return out, None if done else json.dumps([taken[-1][k] for k in keys[n:]])


def pages(laid: SortedRows, values: Sequence, size: int, where: Column | None = None) -> DataFrame:
    """All pages of a prefix at once: its rows that pass ``where``, with ``page`` and ``token``, the one that ``page`` gives at its end.

    Rows are numbered within their file and files' counts are added up in order, so each file is read once by
    a task of its own, however many pages there are, and none of them passes through the driver.
    """
    keys, n = laid._keys(), len(laid.prefix)
    lo, hi = ([F.col(f"{side}.{k}") for k in keys[:n]] for side in ("lo", "hi"))
    files = [r["file"] for r in laid.files().where(~_after(lo, values) & _after(hi, values, strict=False)).select("file").collect()]
    schema = laid.spark.read.parquet(f"{laid.path}/rows").schema
    rows = laid.spark.read.schema(schema).parquet(*files) if files else laid.spark.createDataFrame([], schema)
    rows = rows.withColumn("_file", F.input_file_name())
    for k, v in zip(keys[:n], values, strict=True):
        rows = rows.where(F.col(k) == F.lit(v))
    rows = rows if where is None else rows.where(where)
    key = F.struct(*keys[n:])
    counts = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_rows"), F.min(key).alias("_lo"))
    before = F.sum("_rows").over(Window.orderBy("_lo").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_file", F.coalesce(before, F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_file").orderBy(*keys[n:])
    rows = rows.join(counts, "_file").withColumn("_pos", F.col("_base") + F.row_number().over(inside))
    rows = rows.withColumn("page", F.floor((F.col("_pos") - 1) / size))
    last = rows.where(F.col("_pos") % size == 0).select("page", F.concat(F.lit("["), F.concat_ws(", ", *[F.regexp_extract(F.to_json(F.array(k)), r"(?s)^\[(.*)\]$", 1) for k in keys[n:]]), F.lit("]")).alias("token"))
    return rows.join(last, "page", "left").drop(*keys, "_file", "_base", "_pos")


def upto(laid: SortedRows, limit) -> DataFrame:
    """Rows whose first order column is at most ``limit``, of a layout without prefix: only files that begin by then are opened."""
    first = laid._keys()[0]
    files = [r["file"] for r in laid.files().where(F.col(f"lo.{first}") <= F.lit(limit)).select("file").collect()]
    schema = laid.spark.read.parquet(f"{laid.path}/rows").schema
    if not files:
        return laid.spark.createDataFrame([], schema).drop(*laid._keys())
    return laid.spark.read.schema(schema).parquet(*files).where(F.col(first) <= F.lit(limit)).drop(*laid._keys())
