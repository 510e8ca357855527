"""Percentiles of periods with more values than a sketch holds exactly, ties and nulls among them."""

import math

from pyspark.sql import functions as F

import __spark_entry__ as entry
from mnemo.operators import metrics


def _rows(spark, n):
    value = F.when(F.col("id") % 10 == 0, 7.0).when(F.col("id") % 97 != 1, F.pmod(F.hash("id"), F.lit(1_000_003)) / 7.0)
    return spark.range(n).select((F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=F.col("id") % 172_800)).alias("ts"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("event_type"), value.alias("value"))


def _want(rows, q100):
    cells = {}
    for r in rows.withColumn("day", F.dayofmonth("ts")).collect():
        cells.setdefault((r["day"], r["event_type"]), []).append(r["value"])
    out = {}
    for k, values in cells.items():
        held = sorted(v for v in values if v is not None)
        out[k] = (len(values), held[(len(held) * q100 + 99) // 100 - 1])
    return out


def test_rank_is_exact_and_nulls_count_as_rows(spark):
    rows = _rows(spark, 60_000)
    for q in (1, 50, 95, 100):
        got = metrics.count_quantile(metrics.roll_up_counts(metrics.count_windows(rows, "1 minute", ("event_type",)), "1 day", ("event_type",)), str(q / 100), ("event_type",))
        assert {(r["window_start"].day, r["event_type"]): (r["n"], r["p"]) for r in got.collect()} == _want(rows, q)


def test_query_is_exact_on_large_days(spark, tmp_path):
    rows = _rows(spark, 200_000)
    rows.write.parquet(str(tmp_path / "events.parquet"))
    got = {(r["window_start"] // 86_400 - 19_723 + 1, r["event_type"]): (r["n"], r["p95"]) for r in entry.queries()["latency_p95"](spark, str(tmp_path)).collect()}
    want = _want(rows, 95)
    assert got.keys() == want.keys()
    assert all(got[k][0] == n and math.isclose(got[k][1], p, abs_tol=1e-6) for k, (n, p) in want.items())
