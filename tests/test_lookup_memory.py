"""Lookups of a stream: what can be answered leaves with its batch, and any number of requests is put in order by files."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mnemo.streaming import jobs


def test_requests_are_answered_in_the_batch_they_come_with(spark, tmp_path):
    rows = spark.range(0, 600, numPartitions=1).select(F.lit("c").alias("cache"), F.concat(F.lit("k"), F.col("id") % 7).alias("content_hash"), F.timestamp_seconds(86_400 + (F.col("id") * 7 % 600) * 60).alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    answered = []
    stream = jobs.cached_lookups(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), capacity=3, seconds=600)
    jobs.each_batch(stream, lambda df, k: answered.append([(r["at"], r["content_hash"], r["hit"]) for r in df.collect()]), str(tmp_path / "state")).awaitTermination()
    asked = sorted((r["ts"].timestamp() * 1000, r["content_hash"]) for r in rows.collect())
    cache = jobs.LruCache([], 3, 600)
    want = [(int(at), key, cache.ask(key, int(at))) for at, key in asked if at < 86_400_000 + 599 * 60_000 - 3_600_000]
    assert answered[0] == want
    assert not any(answered[1:])


def test_requests_in_order_over_many_runs(tmp_path):
    found = jobs._InOrder(str(tmp_path))
    found.RUN_ROWS, found.BATCH_ROWS = 10, 3
    rows = [(k * 37 % 101, f"k{k % 5}é") for k in range(95)]
    for at in range(0, 95, 4):
        found.add(pa.array([t for t, _ in rows[at : at + 4]]), pa.array([n for _, n in rows[at : at + 4]]))
    assert list(found) == sorted(rows) and found.runs > 3
    with pytest.raises(StopIteration):
        next(iter(jobs._InOrder(str(tmp_path))))
