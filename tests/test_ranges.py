"""Sorted layouts and pages by cursor; chains and closures; caches and alarms over unordered events; sketches."""

import random

import pytest
from pyspark.sql import functions as F

from mnemo.operators import graph, metrics
from mnemo.sources import ranges
from mnemo.streaming import jobs


def test_pages_chain_and_open_few_files(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 40, "small").otherwise("big").alias("task"), (F.col("id") * 7919 % 500).alias("at"), F.format_string("k%04d", "id").alias("key"), (F.col("id") % 3).alias("kind"))
    laid = ranges.lay(rows, ["task"], [("at", True), ("key", False)], file_rows=50)
    every = sorted(((r["task"], -r["at"], r["key"], r["kind"]) for r in rows.collect()))
    for task, kind in (("small", None), ("big", None), ("big", 1), ("none", None)):
        want = [x[2] for x in every if x[0] == task and kind in (None, x[3])]
        got, token = [], None
        for step in range(4):
            page, token = ranges.page(laid, [task], 30, token, None if kind is None else F.col("kind") == kind)
            got += [r["key"] for r in page.collect()]
            if token is None:
                break
        assert got == want[:120] and (token is None) == (len(want) < 120 or task == "none")
    _, token = ranges.page(laid, ["big"], 30)
    import json

    late = [-every[2500][1] * -1, every[2500][2]]
    sizes = [len(ranges.page_files(laid, ["big"], 30, c)) for c in (None, json.loads(token), late)]
    assert max(sizes) <= 3 and laid.files().count() > 50
    due = ranges.lay(rows, [], [("at", False), ("key", False)], file_rows=50)
    assert ranges.upto(due, 20).count() == rows.where("at <= 20").count() and ranges.upto(due, -1).count() == 0
    empty = ranges.lay(rows.limit(0), ["task"], [("at", True), ("key", False)])
    assert ranges.page(empty, ["big"], 3)[0].count() == 0


def test_long_chains_broken_branching_and_circular(spark):
    n = 3000
    order = list(range(n))
    random.Random(1).shuffle(order)
    rows = [("i", f"k{i}", f"k{i - 1}" if i else None) for i in order]
    rows += [("i", "lost1", "nowhere"), ("i", "lost2", "lost1"), ("i", "a", None), ("i", "b", "a"), ("i", "c", "a"), ("i", "d", "c"), ("i", "x", "z"), ("i", "y", "x"), ("i", "z", "y"), ("i", "w", "x"), ("j", "k5", None)]
    got = {(r["index_name"], r["key"]): tuple(r)[2:] for r in graph.version_chain(spark.createDataFrame(rows, "index_name string, key string, supersedes string")).collect()}
    assert all(got["i", f"k{i}"] == ("k0", i + 1, n, "whole") for i in range(n))
    assert got["i", "lost2"] == ("lost1", 2, 2, "broken") and got["i", "d"] == ("a", 3, 3, "branching") and got["j", "k5"] == ("k5", 1, 1, "whole")
    assert {got["i", k] for k in "xyzw"} == {(None, None, None, "cycle")}


def test_closure_of_cycles_and_long_chains(spark):
    links = [(f"c{i}", [f"c{i - 1}"]) for i in range(1, 26)] + [("c0", ["c3"]), ("c7", ["c6", "gone"]), ("alone", [])]
    mem = spark.createDataFrame([("i", c, "active", on) for c, on in links], "index_name string, canonical_id string, status string, linked_ids array<string>")
    got = {(r["root"], r["canonical_id"]): r["level"] for r in graph.impact(mem, spark.createDataFrame([("i", "c1"), ("i", "alone")], "index_name string, canonical_id string")).collect()}
    want = {("alone", "alone"): 0} | {("c1", f"c{i}"): i - 1 for i in range(1, 26)} | {("c1", "c0"): 3}
    assert got == want
    plan = lambda depth: graph.impact(mem, mem.select("index_name", "canonical_id"), depth)._jdf.queryExecution().executedPlan().toString().count("\n")
    assert plan(2) == plan(6)


def stream_of(spark, rows, schema, tmp_path, files):
    """A stream of one file at a time, in the given order."""
    for k in range(files):
        spark.createDataFrame(rows[k::files], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_cache_equals_a_sequential_one(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"p{rng.randrange(2)}", f"h{rng.randrange(12)}", 1_700_000_000 + rng.randrange(9000)) for _ in range(700)]
    rows = list({(c, t): (c, h, t) for c, h, t in rows}.values())
    stream = stream_of(spark, rows, "cache string, content_hash string, t long", tmp_path, 3).withColumn("ts", F.timestamp_seconds("t"))
    got = jobs.run_to_table(jobs.cached_lookups(stream, capacity=4, seconds=300, late="4 hours").drop("late"), "t1").collect()
    assert got == [] or max(r["at"] for r in got) < (max(r[2] for r in rows) - 4 * 3600) * 1000
    (tmp_path / "again").mkdir()
    ends = [*rows, ("p0", "end", 1_700_100_000), ("p1", "end", 1_700_100_001)]
    stream = stream_of(spark, ends, "cache string, content_hash string, t long", tmp_path / "again", 1).withColumn("ts", F.timestamp_seconds("t"))
    got = {(r["cache"], r["at"] // 1000): r["hit"] for r in jobs.run_to_table(jobs.cached_lookups(stream, capacity=4, seconds=300, late="1 hour"), "t2").collect()}
    want = {}
    for name in ("p0", "p1"):
        held: dict = {}
        for _, h, t in sorted((r for r in rows if r[0] == name), key=lambda r: r[2]):
            put = held.pop(h, None)
            hit = put is not None and t - put < 300
            held[h] = put if hit else t
            if len(held) > 4:
                held.pop(next(iter(held)))
            want[name, t] = hit
    assert got == want and any(want.values()) and not all(want.values())


@pytest.mark.parametrize(("below", "rate"), [(False, False), (True, True)])
def test_alarm_stream_equals_batch_on_shuffled_rows(spark, tmp_path, below, rate):
    rng = random.Random(6)
    rows = [("m", 1_700_000_000 // 60 * 60 + 60 * w + rng.randrange(60), float(rng.randrange(9)), float(rng.randrange(9))) for w in range(60) if w % 13 for _ in range(2)]
    rng.shuffle(rows)
    rows.append(("m", 1_700_000_000 + 99_999, 0.0, 0.0))
    schema = "metric string, t long, up double, down double"
    stream = stream_of(spark, rows, schema, tmp_path, 1).withColumn("ts", F.timestamp_seconds("t"))
    got = {r["window_start"].timestamp(): (r["breach"], r["alarm"]) for r in jobs.run_to_table(jobs.stream_alarms(stream, 60, 50.0 if rate else 6.0, 3, below, rate, late="1 hour"), "t3").collect()}
    table = spark.createDataFrame(rows[:-1], schema).groupBy(F.window(F.timestamp_seconds("t"), "1 minute").alias("w"), "metric").agg(F.sum("up").alias("u"), F.sum("down").alias("d")).select(F.col("w.start").alias("window_start"), "metric", (F.try_divide(100 * F.col("u"), F.col("u") + F.col("d")) if rate else F.col("u")).alias("total"))
    want = {r["window_start"].timestamp(): (r["breach"], r["alarm"]) for r in metrics.alarms(table, 50.0 if rate else 6.0, 3, 60, below=below).collect()}
    assert got == want and any(a for _, a in got.values())


def test_sketches_roll_up_within_their_error(spark):
    events = spark.range(200_000).select(F.timestamp_seconds(1_700_000_000 + F.col("id") % 86_400).alias("ts"), F.pow(F.rand(3), 3).alias("value")).cache()
    minutes = metrics.sketch_windows(events, "1 minute", k=512)
    rolled = metrics.roll_up(metrics.roll_up(minutes, "1 hour", k=512), "1 day", k=512)
    for r in metrics.sketch_quantile(rolled, 0.95).collect():
        day = events.where((F.col("ts") >= r["window_start"]) & (F.col("ts") < F.lit(r["window_start"]) + F.expr("interval 1 day")))
        assert r["n"] == day.count() and abs(day.where(F.col("value") <= r["p"]).count() / r["n"] - 0.95) < 0.01
