"""Stored tables, the view kept up from changes, and the stored vector index."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemo.operators import search, vector_index, view
from mnemo.sources.shared import shared_path
from mnemo.sources.stored import CommitConflict, StoredTable

listed = lambda df, *c: sorted(map(tuple, df.select(*c).collect()), key=repr)


def test_table_equals_a_dict_over_versions(spark):
    rng = random.Random(1)
    t = StoredTable.create(spark, shared_path(spark, "table"), "k string, g int, v string", ["k"], ["g"], buckets=8)
    held, past = {}, {}
    for step in range(9):
        keys = rng.sample([f"k{i}" for i in range(30)], 7)
        rows = spark.createDataFrame([(k, int(k[1:]) % 5, f"{step}") for k in keys], "k string, g int, v string")
        if step % 3 == 2:
            version = t.delete(rows.select("k", "g"))
            held = {k: v for k, v in held.items() if k not in keys}
        else:
            version = t.upsert(rows)
            held |= {k: (int(k[1:]) % 5, f"{step}") for k in keys}
        if step == 4:
            version = t.compact()
        past[version] = dict(held)
        assert {r["k"]: (r["g"], r["v"]) for r in t.read().collect()} == held
    assert {r["k"]: (r["g"], r["v"]) for r in t.read(min(past)).collect()} == past[min(past)]
    asked = spark.createDataFrame([("k1", 1), ("nope", 1)], "k string, g int")
    assert {r["k"] for r in t.get(asked).collect()} == {"k1"} & set(held)
    state = t.snapshot()[1]
    assert len(t.files(state, t.buckets_of(asked))) < len(t.files(state))


def test_failed_and_late_commits_are_unseen(spark, monkeypatch):
    t = StoredTable.create(spark, shared_path(spark, "table"), "k int, v int", ["k"], buckets=4)
    rows = lambda v: spark.createDataFrame([(i, v) for i in range(6)], "k int, v int")
    t.upsert(rows(1))
    with monkeypatch.context() as m:
        m.setattr(StoredTable, "_commit", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            t.upsert(rows(2))
        with pytest.raises(OSError):
            t.compact()
    assert {r["v"] for r in t.read().collect()} == {1}
    version, state = t.snapshot()
    t.upsert(rows(3))
    with pytest.raises(CommitConflict):
        t._commit(version + 1, state)
    assert {r["v"] for r in t.read().collect()} == {3} and not [f for f in t._fs.listStatus(t._at("versions")) if "partial" in f.getPath().getName()]
    t.compact()
    assert t.vacuum() > 0 and {r["v"] for r in t.read().collect()} == {3}
    assert t.vacuum() == 0 and len(t.versions()) == 1


def test_compaction_leaves_untouched_buckets(spark):
    t = StoredTable.create(spark, shared_path(spark, "table"), "k int, v int", ["k"], buckets=8)
    t.upsert(spark.range(200).select(F.col("id").cast("int").alias("k"), F.lit(0).alias("v")))
    t.compact()
    before = t.snapshot()[1]["base"]
    one = spark.createDataFrame([(7, 1)], "k int, v int")
    t.upsert(one)
    t.compact()
    after = t.snapshot()[1]["base"]
    changed = [b for b in before if before[b] != after[b]]
    assert changed == [str(b) for b in t.buckets_of(one)] and t.read().where("v = 1").count() == 1 and t.read().count() == 200


def test_view_follows_changes(spark):
    rng = random.Random(3)
    records, held = view.create(spark, shared_path(spark, "view"), buckets=16)
    state = {}
    columns = "index_name string, key string, canonical_id string, doc_id long, version int, task_id string, agent_id string, memory_type string, status string, created_at long"
    for step in range(6):
        rows = []
        for _ in range(8):
            i = rng.randrange(40)
            rows.append(("shared", f"k{i}", None if i == 3 else f"c{i % 9}", i, i // 9 + 1, "t", "a", "semantic", rng.choice(["active", "superseded"]), i))
        rows = list({r[1]: r for r in rows}.values())
        if step % 2:
            gone = rng.sample(sorted(state), min(6, len(state)))
            view.delete(records, held, spark.createDataFrame([(state[k][0], k, state[k][2]) for k in gone], "index_name string, key string, canonical_id string"))
            state = {k: v for k, v in state.items() if k not in gone}
        else:
            view.upsert(records, held, spark.createDataFrame(rows, columns))
            state |= {r[1]: r for r in rows}
        want = search.latest_view(spark.createDataFrame(list(state.values()), columns))
        assert listed(held.read(), *view.GROUP, "key", "status", "n_versions") == listed(want, *view.GROUP, "key", "status", "n_versions")
    held.compact()
    before = held.snapshot()[1]["base"]
    row = spark.createDataFrame([("shared", "k99", "c0", 99, 99, "t", "a", "semantic", "active", 99)], columns)
    view.upsert(records, held, row)
    held.compact()
    after = held.snapshot()[1]["base"]
    assert [b for b in before if after.get(b) != before[b]] == [str(b) for b in held.buckets_of(row)]
    records.upsert(row.withColumn("status", F.lit("archived")))  # a writer that died before the view's commit
    assert view.repair(records, held) == 1 and view.repair(records, held) == 0


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 24))
    rows = [(i, [float(x) for x in centres[i % 40] + 0.45 * rng.normal(size=24)], i % 40) for i in range(4000)]
    return spark.createDataFrame([*rows, (9001, None, 1), (9002, [0.0] * 24, 1)], "vec_id long, embedding array<float>, label int").cache()


def test_index_recall_and_files(spark, vectors):
    index = vector_index.build(vectors, fields=["label"], cells=64)
    assert index.rows().count() == 4000 and index.centres.agg(F.sum("n")).first()[0] == 4000
    asked = vectors.where("vec_id % 20 = 0")
    truth = {(r["query_id"], r["id"]) for r in search.batch_top_k(asked, vectors, 10).collect()}
    found = {(r["query_id"], r["id"]) for r in vector_index.top_k(index, asked, 10).collect()}
    assert len(truth & found) / len(truth) >= 0.95
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    assert files(index.rows([3])) < files(index.rows([3, 4, 5])) < files(index.rows())


def test_index_exact_search_equals_the_scan(spark, vectors):
    index = vector_index.build(vectors, fields=["label"], cells=32)
    asked = vectors.where("vec_id % 50 = 0")
    shape = ("query_id", "id", "distance", "rank")
    assert listed(vector_index.top_k(index, asked, 10, probes=2, exact=True), *shape) == listed(search.batch_top_k(asked, vectors, 10), *shape)
    hit = F.col("label") == 7
    may = lambda c: (F.col("label_min") <= 7) & (F.col("label_max") >= 7)
    assert listed(vector_index.top_k(index, asked, 10, probes=1, where=hit, may_hold=may, exact=True), *shape) == listed(search.batch_top_k(asked, vectors.where(hit), 10), *shape)
    none = vector_index.build(vectors.limit(0))
    assert vector_index.top_k(none, asked, 3).count() == 0
