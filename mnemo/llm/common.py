"""Shared pieces of the training-data operators: tables, written intermediates, prefix sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local master may go without one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_SCOPES: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables and files that operators write in the shared folder inside this scope are deleted at its end.

    What is read from them lazily must be written elsewhere, or collected, before.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


@contextmanager
def small_batches(spark: SparkSession, rows: int = 256) -> Iterator[None]:
    """While this lasts, Spark hands rows to Python a few hundred at a time: batches of long texts stay small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path, partitionBy=list(partition_by) or None)
    return spark.read.schema(df.schema).parquet(path)


def join_small(df: DataFrame, small: DataFrame, on: str | Sequence[str], how: str = "left", spread: str | None = None, limit: int = 16 << 20) -> DataFrame:
    """Join a written table that is probably small: broadcast if its rows' bytes are at most ``limit``.

    Beyond it the join is a shuffle; with ``spread``, a column of ``df`` by which each key's rows are
    dealt to 32 salts, so that a key with a third of all rows is no single task's work.
    """
    text = [F.coalesce(F.octet_length(F.to_json(F.struct(*[F.col(c) for c in small.columns]))), F.lit(0))]
    if (small.agg(F.sum(text[0])).first()[0] or 0) <= limit:
        return df.join(F.broadcast(small), on, how)
    if spread is None:
        return df.join(small, on, how)
    on = [on] if isinstance(on, str) else list(on)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
    return df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(32)).cast("int")).join(salted, [*on, "_salt"], how).drop("_salt")


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches a few hundred rows at a time: what Python makes of a batch of long texts stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def row_hashes(*columns: str) -> list[Column]:
    """Two columns, _h1 and _h2: 128 bits that tell rows apart by these columns, nulls included."""
    values = [x for c in columns for x in (F.col(c), F.isnull(c))]
    return [F.xxhash64(*values).alias("_h1"), F.xxhash64(F.lit("again"), *values).alias("_h2")]


def running_total(df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], value: str, out: str) -> DataFrame:
    """Exclusive prefix sums of ``value`` within ``keys``, ordered by (chunk, order), in two levels.

    Chunk totals are summed first and scanned per key, then rows are scanned inside their chunk, so
    a key that holds a third of all rows is spread over its chunks. Keys must not be null.
    """
    by = [*keys, chunk]
    totals = df.groupBy(*by).agg(F.sum(value).alias("_total"))
    over_chunks = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*by, F.coalesce(F.sum("_total").over(over_chunks), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(bases, by)
        .withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_base")
    )


def prefix_sums(df: DataFrame, order: Sequence[Column], sums: dict[str, Column], one_task: bool) -> DataFrame:
    """Exclusive prefix sums of whole numbers along one order of all rows, which must tell them apart.

    ``one_task`` is for tables of a checked size. Others are laid in ranges of that order, written, and
    the ranges' totals, a row each, carried from one to the next.
    """
    if one_task:
        before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.select("*", *[F.coalesce(F.sum(value).over(before), F.lit(0)).cast("long").alias(name) for name, value in sums.items()])
    rows = df.select("*", *[value.cast("long").alias(f"_v_{name}") for name, value in sums.items()])
    rows = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_range").agg(*[F.sum(f"_v_{name}").alias(name) for name in sums])
    bases = totals.select("_range", *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"_b_{name}") for name in sums])
    before = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(F.broadcast(bases), "_range")
    return joined.select(*df.columns, *[(F.col(f"_b_{name}") + F.coalesce(F.sum(f"_v_{name}").over(before), F.lit(0))).cast("long").alias(name) for name in sums])
