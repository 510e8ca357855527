"""All pages at once equal the pages that their tokens lead to, and take no job a page."""

import pytest
from pyspark.sql import functions as F

from mnemo.sources import ranges


@pytest.fixture(scope="module")
def laid(spark):
    rows = spark.range(900).select(F.concat(F.lit("g"), F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 450).alias("at"), F.concat(F.lit('k"\\é'), F.col("id")).alias("key"), (F.col("id") % 4).alias("kind"))
    return ranges.lay(rows, ["g"], [("at", True), ("key", False)], file_rows=16)


@pytest.mark.parametrize(("group", "size", "kind"), [("g1", 7, 2), ("g0", 25, 1), ("g2", 300, 5), ("g3", 7, 1)])
def test_pages_are_those_of_the_tokens(laid, group, size, kind):
    where = F.col("kind") < kind
    got = {}
    for r in ranges.pages(laid, [group], size, where).collect():
        got.setdefault((r["page"], r["token"]), []).append((r["at"], r["key"], r["kind"]))
    token, n, seen = None, 0, 0
    while n == 0 or token:
        rows, token = ranges.page(laid, [group], size, token, where)
        want = sorted((r["at"], r["key"], r["kind"]) for r in rows.collect())
        here = [(t, sorted(found)) for (page, t), found in got.items() if page == n]
        assert [found for _, found in here] == ([want] if want else [])
        if token and want:
            assert ranges.json.loads(here[0][0]) == ranges.json.loads(token)
        n, seen = n + 1, seen + len(want)
        if n > 12:  # enough pages followed
            return
    assert seen == sum(map(len, got.values()))


def test_many_pages_are_few_jobs(spark, laid):
    tracker, group = spark.sparkContext.statusTracker(), "pages-test"
    spark.sparkContext.setJobGroup(group, group)
    assert ranges.pages(laid, ["g1"], 1).count() == 300
    assert len(tracker.getJobIdsForGroup(group)) < 20
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
