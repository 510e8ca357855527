"""Operational metrics: tumbling windows, rates, percentiles and consecutive-period alarms."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from mnemo.sources.shared import Work


def metric_windows(events: DataFrame, period: str, ts: str = "ts", name: str = "event_type", value: str = "value") -> DataFrame:
    """(window_start, metric, n, total, peak) of each metric and period. Batch and streaming alike."""
    at = F.col(ts) if events.schema[ts].dataType == TimestampType() else F.col(ts).cast("timestamp")  # a cast would hide a watermark
    return events.groupBy(F.window(at, period).alias("w"), F.col(name).alias("metric")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(value).alias("peak")).select(F.col("w.start").alias("window_start"), "metric", "n", "total", "peak")


def facts(df: DataFrame, at: str, counted: dict[str, Column]) -> DataFrame:
    """(ts, name, value, unit): a fact for each named condition that holds in a row, as an emitter would append them. One pass."""
    named = F.array_compact(F.array(*[F.when(F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in counted.items()]))
    return df.select(F.col(at).alias("ts"), F.explode(named).alias("name")).select("ts", "name", F.lit(1.0).alias("value"), F.lit("Count").alias("unit"))


SKETCH_K = 4096
#: Rank error of a sketch of this size at 99 % confidence; up to about SKETCH_K values it is exact.
RANK_ERROR = 0.001


def sketch_windows(events: DataFrame, period: str = "1 minute", by: tuple[str, ...] = (), ts: str = "ts", value: str = "value", k: int = SKETCH_K) -> DataFrame:
    """(window_start, by, sketch): a mergeable quantile sketch of each period. To be stored; coarser periods are made from it."""
    w = F.window(F.col(ts).cast("timestamp"), period)
    return events.where(F.col(value).isNotNull()).groupBy(w.alias("w"), *by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch")).select(F.col("w.start").alias("window_start"), *by, "sketch")


def roll_up(sketches: DataFrame, period: str, by: tuple[str, ...] = (), k: int = SKETCH_K) -> DataFrame:
    """Sketches of a longer period, merged from those of shorter ones: no event is read again."""
    merged = sketches.groupBy(F.window("window_start", period).alias("w"), *by).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))
    return merged.select(F.col("w.start").alias("window_start"), *by, "sketch")


def sketch_quantile(sketches: DataFrame, q: float, name: str = "p") -> DataFrame:
    """Adds ``n`` and the least value whose rank is at least ``q``, within RANK_ERROR of it."""
    return sketches.withColumn("n", F.kll_sketch_get_n_double("sketch")).withColumn(name, F.kll_sketch_get_quantile_double("sketch", F.lit(q))).drop("sketch")


def percentile_windows(events: DataFrame, period: str, q: float, ts: str = "ts", value: str = "value") -> DataFrame:
    """(window_start, n, p) by sketches: a task holds SKETCH_K values or so of a window, however many there are."""
    return sketch_quantile(sketch_windows(events, period, ts=ts, value=value), q)


def count_windows(events: DataFrame, period: str = "1 minute", by: tuple[str, ...] = (), ts: str = "ts", value: str = "value") -> DataFrame:
    """(window_start, by, value, n): how often each value came in each period, nulls included. To be stored; coarser periods are made from it, exactly."""
    w = F.window(F.col(ts).cast("timestamp"), period)
    return events.groupBy(w.alias("w"), *by, F.col(value).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *by, "value", "n")


def roll_up_counts(counts: DataFrame, period: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts of a longer period, added up from those of shorter ones: no event is read again."""
    added = counts.groupBy(F.window("window_start", period).alias("w"), *by, "value").agg(F.sum("n").alias("n"))
    return added.select(F.col("w.start").alias("window_start"), *by, "value", "n")


def count_quantile(counts: DataFrame, q: str, by: tuple[str, ...] = (), name: str = "p") -> DataFrame:
    """(window_start, by, n, p): all rows of each period, and the least value that a share of at least ``q``, a decimal, of its values doesn't exceed. Exact.

    Counts are written in ranges of period and value. A total for each range says which one holds the rank, and
    only that range's rows are counted up, so that a period with a third of all events is no single task's work.
    """
    cell = ["window_start", *by]
    keyed = counts.select(F.struct(*cell).alias("cell"), "value", "n")
    work = Work(counts.sparkSession, "counts")
    rows = work.written(keyed.repartitionByRange("cell", "value").withColumn("range", F.spark_partition_id()))
    totals = rows.groupBy("cell", "range").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("held"))
    whole, before = Window.partitionBy("cell"), Window.partitionBy("cell").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("cell", "range", "held", F.sum("rows").over(whole).alias("all"), F.ceil(F.sum("held").over(whole).cast("decimal(20,0)") * F.lit(Decimal(q))).cast("long").alias("rank"), F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    totals = work.written(totals)
    holds = totals.where((F.col("base") < F.col("rank")) & (F.col("rank") <= F.col("base") + F.col("held"))).select("cell", "range", "rank", "base")
    upto = Window.partitionBy("cell").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.where("value IS NOT NULL").join(holds, ["cell", "range"]).withColumn("upto", F.col("base") + F.sum("n").over(upto))
    found = found.where(F.col("upto") >= F.col("rank")).groupBy("cell").agg(F.min("value").alias(name))
    every = totals.groupBy("cell").agg(F.max("all").alias("n")).withColumnRenamed("cell", "_cell")
    return every.join(found, F.col("_cell").eqNullSafe(F.col("cell")), "left").select("_cell.*", "n", name)


def ratio_windows(events: DataFrame, period: str, hit: str, miss: str, ts: str = "ts", name: str = "event_type") -> DataFrame:
    """100 * hits / (hits + misses) of each period; null where there were neither."""
    w = F.window(F.col(ts).cast("timestamp"), period)
    hits, misses = F.count_if(F.col(name) == hit), F.count_if(F.col(name) == miss)
    return events.groupBy(w.alias("w")).agg(hits.alias("hits"), misses.alias("misses")).select(F.col("w.start").alias("window_start"), "hits", "misses", F.try_divide(100.0 * F.col("hits"), F.col("hits") + F.col("misses")).alias("hit_rate"))


def summed_windows(events: DataFrame, period: str, names: tuple[str, ...], label: str, ts: str = "ts", name: str = "event_type", value: str = "value") -> DataFrame:
    """(window_start, metric, total) of several series added up, as client and server errors are."""
    w = F.window(F.col(ts).cast("timestamp"), period)
    return events.where(F.col(name).isin(*names)).groupBy(w.alias("w")).agg(F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), F.lit(label).alias("metric"), "total")


def alarms(windows: DataFrame, threshold: float, periods: int, step_seconds: int, value: str = "total", below: bool = False) -> DataFrame:
    """Adds ``breach`` and ``alarm``: over the threshold (or under it), for ``periods`` periods in a row.

    A period without a window, or without a value, is no breach.
    """
    at = F.unix_timestamp("window_start")
    w = Window.partitionBy("metric").orderBy(at).rangeBetween(-(periods - 1) * step_seconds, 0)
    over = F.col(value) < threshold if below else F.col(value) > threshold
    breach = F.coalesce(over, F.lit(False)).cast("int")
    return windows.withColumn("breach", breach == 1).withColumn("alarm", F.sum(breach).over(w) == periods)
