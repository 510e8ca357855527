"""The engine's operators on tiny tables, and closed forms against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from mnemo.functions import text as T
from mnemo.operators import budget, bundles, evaluate, filters, graph, ingest, lifecycle, listing, metrics, search, store, writes
from mnemo.sources import documents, tables

MEM = (
    "index_name string, key string, canonical_id string, task_id string, agent_id string, team_id string, memory_type string, status string, version int, created_at long, expires_at long, "
    "archived_at long, supersedes string, parent_key string, linked_ids array<string>, content string, content_summary string, content_hash string, doc_id long, confidence double"
)


def mem(spark, *rows):
    base = dict(index_name="shared", canonical_id="c", task_id="t", agent_id="a", team_id="x", memory_type="semantic", status="active", version=1, created_at=1, expires_at=9_999_999_999, archived_at=None,
                supersedes=None, parent_key=None, linked_ids=[], content="", content_summary=None, content_hash="sha256:0", confidence=None)
    out = []
    for n, r in enumerate(rows):
        out.append(base | {"doc_id": n, "key": f"k{n}"} | r)
    names = [p.split()[0] for p in MEM.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in out], MEM)


def test_normalised_hash_ignores_case_and_space(spark):
    df = spark.createDataFrame([("A  b C ",), ("a b c",)], "t string")
    assert df.select(T.content_hash(F.col("t"))).distinct().count() == 1


def test_collapse_keeps_highest_version_then_newest(spark):
    hits = mem(spark, dict(canonical_id="f", version=1), dict(canonical_id="f", version=2), dict(canonical_id="o"), dict(canonical_id="g", created_at=100), dict(canonical_id="g", created_at=999)).withColumn("pos", F.col("doc_id"))
    rows = {r["canonical_id"]: r for r in search.collapse_latest(hits, ["index_name"], ["pos"]).collect()}
    assert rows["f"]["key"] == "k1" and rows["f"]["group_order"]["pos"] == 0
    assert rows["o"]["key"] == "k2" and rows["g"]["key"] == "k4"


def greedy(items):
    left, out = list(items), []
    while left:
        best = None
        for i in left:
            sim = max((1.0 if i["c"] == o["c"] else 0.5 if i["t"] == o["t"] else 0.0 for o in out), default=0.0)
            value = 0.75 * i["s"] - 0.25 * sim
            if best is None or value > best[0] + 1e-12:
                best = (value, i)
        left.remove(best[1])
        out.append(best[1])
    return [i["pos"] for i in out]


def test_mmr_equals_greedy_selection(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for q in range(60):
        items = []
        for pos in range(rng.randint(1, 12)):
            task = rng.choice("abc")
            items.append({"pos": pos, "t": task, "c": task + str(rng.randint(0, 3)), "s": rng.randint(0, 20) / 20})
        want[q] = greedy(items)
        rows += [(q, i["pos"], i["t"], i["c"], i["s"]) for i in items]
    df = spark.createDataFrame(rows, "q int, pos int, task_id string, canonical_id string, score double")
    got = {}
    for r in search.mmr_order(df, ["q"]).orderBy("q", "rank").collect():
        got.setdefault(r["q"], []).append(r["pos"])
    assert got == want


def test_greedy_fold_where_a_canonical_spans_tasks(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for q in range(40):
        items = [{"pos": pos, "t": rng.choice("abc"), "c": str(rng.randint(0, 3)), "s": rng.randint(0, 20) / 20} for pos in range(rng.randint(1, 10))]
        want[q] = greedy(items)
        rows += [(q, i["pos"], i["t"], i["c"], i["s"]) for i in items]
    df = spark.createDataFrame(rows, "q int, pos int, task_id string, canonical_id string, score double")
    got = {}
    for r in search.mmr_greedy(df, ["q"]).orderBy("q", "rank").collect():
        got.setdefault(r["q"], []).append(r["pos"])
    assert got == want


def test_budget_window_equals_loop(spark):
    rng = random.Random(2)
    rows, want = [], set()
    for g in range(80):
        used = 0
        stop = False
        for pos in range(1, rng.randint(2, 9)):
            n = rng.choice([0, 5, 10, 30])
            rows.append((g, pos, n))
            if not stop and (pos == 1 or used + n <= 40):
                want.add((g, pos))
                used += n
            else:
                stop = True
    df = spark.createDataFrame(rows, "g int, pos int, tokens int")
    assert {(r.g, r.pos) for r in budget.within_budget(df, ["g"], "pos", 40).collect()} == want


def test_substitution_takes_summaries_then_stops(spark):
    df = spark.createDataFrame([("q", 1, 100, 5), ("q", 2, 100, 5), ("q", 3, 100, 5), ("q", 4, 100, 50)], "q string, rank int, full_tokens int, summary_tokens int")
    got = [(r["rank"], r["detail"]) for r in budget.with_substitution(df, ["q"], "rank", 120).orderBy("rank").collect()]
    assert got == [(1, "full"), (2, "summary"), (3, "summary")]


def test_hydrate_upgrade_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([("q", 1, 10, 100, 2), ("q", 2, 10, 20, 1), ("q", 3, 10, 15, None)], "q string, rank int, tokens long, full_tokens long, wanted_pos int")
    got = {r["rank"]: (r["hydrated"], r["tokens"]) for r in budget.hydrate_upgrade(df, ["q"], "rank", 60).collect()}
    assert got == {1: (False, 10), 2: (True, 20), 3: (False, 10)}


def test_filters(spark):
    df = mem(spark, dict(linked_ids=["A", "B"], version=3), dict(team_id="y"))
    assert df.where(filters.compile_filter({"linked_ids": "A"})).count() == 1
    assert df.where(filters.compile_filter({"version": {"$gt": 2}, "$or": [{"team_id": "x"}, {"team_id": "y"}]})).count() == 1
    assert df.where(filters.compile_filter({"archived_at": {"$lt": 5}})).count() == 0
    with pytest.raises(filters.FilterError):
        filters.compile_filter({"content": "x"})
    with pytest.raises(filters.FilterError):
        filters.compile_filter({"team_id": {"$gt": "x"}})


def test_promotion(spark):
    table = mem(spark, dict(memory_type="document", key="D"), dict(memory_type="chunk", parent_key="D"), dict(memory_type="chunk", parent_key="D"), dict(memory_type="chunk"), dict(memory_type="chunk", parent_key="gone"))
    hits = table.where("doc_id > 0").withColumn("pos", F.col("doc_id")).withColumn("query_id", F.lit(1))
    got = [(r["pos"], r["key"]) for r in search.promote_chunks(hits, table, ["query_id"]).orderBy("pos").collect()]
    assert got == [(1, "D"), (4, "k4")]


def test_store_decisions(spark):
    v = [1.0, 0.0]
    table = mem(spark, dict(content_hash="sha256:h", key="old")).withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)))
    rows = [(1, "sha256:h", None, "auto"), (2, "sha256:n", None, "auto"), (3, "sha256:m", None, "new"), (4, "sha256:s", "old", "auto")]
    inc = spark.createDataFrame([(s, "shared", "t", "a", h, v, k, m) for s, h, k, m in rows], "seq int, index_name string, task_id string, agent_id string, content_hash string, embedding array<double>, supersedes_key string, mode string")
    got = {r["seq"]: (r["action"], r["match_key"]) for r in writes.classify(inc, table).collect()}
    assert got == {1: ("unchanged", "old"), 2: ("duplicate_detected", "old"), 3: ("created", None), 4: ("superseded", "old")}


def test_validation_counts_escaped_bytes(spark):
    df = mem(spark, dict(parent_key="é" * 400), dict(content="x" * 2100), dict(content="x" * 2100, content_summary="s"), dict(memory_type="chunk"), dict(agent_id=" "))
    assert [r["problem"] for r in store.validate(df).orderBy("doc_id").collect()] == ["metadata too large", "summary required", None, "chunk without parent", "bad identifier"]


def test_log_keeps_last_state(spark):
    log = spark.createDataFrame([("i", "k", 1, "a", False), ("i", "k", 2, "b", False), ("i", "z", 1, "a", False), ("i", "z", 3, "a", True)], "index_name string, key string, op_seq int, status string, deleted boolean")
    assert [(r["key"], r["status"]) for r in store.current_state(log).collect()] == [("k", "b")]


def test_lifecycle(spark):
    day = 86_400
    table = mem(
        spark, dict(key="v1", status="superseded", canonical_id="A"), dict(key="v2", supersedes="v1", created_at=1, version=2, canonical_id="A"), dict(key="old", status="archived", archived_at=1, canonical_id="C"), dict(key="gone", expires_at=5, canonical_id="D"),
        dict(key="fresh", status="superseded", canonical_id="B"), dict(key="new", supersedes="fresh", created_at=40 * day, version=2, canonical_id="B")
    )
    after, counts = lifecycle.sweep(table, 41 * day)
    assert counts == {"archived": 1, "deleted": 2}
    assert {r["key"]: r["status"] for r in after.collect()} == {"v1": "archived", "v2": "active", "fresh": "superseded", "new": "active"}
    assert lifecycle.sweep(table, 41 * day, dry_run=True)[0].count() == 6
    with pytest.raises(lifecycle.CircuitBreaker):
        lifecycle.sweep(table, 41 * day, cap=1, share=0.0)


def test_graph(spark):
    table = mem(spark, dict(key="mem_a_t_1_v1", content="see mem_a_t_2_v1", canonical_id="A"), dict(key="mem_a_t_2_v1", content="back to mem_a_t_1_v1", canonical_id="B", linked_ids=["A"]), dict(key="mem_a_t_3_v1", canonical_id="C", linked_ids=["B"]))
    seeds = spark.createDataFrame([("mem_a_t_1_v1", "shared")], "seed string, index_name string")
    got = [r["key"] for r in graph.expand(seeds, graph.edges(table), depth=3).orderBy("pos").collect()]
    assert got == ["mem_a_t_1_v1", "mem_a_t_2_v1"]
    assert [r["key"] for r in graph.linked_by(table, "A").collect()] == ["mem_a_t_2_v1"]
    roots = spark.createDataFrame([("shared", "A")], "index_name string, canonical_id string")
    assert {(r["canonical_id"], r["level"]) for r in graph.impact(table, roots, 2).collect()} == {("A", 0), ("B", 1), ("C", 2)}
    assert {r["canonical_id"] for r in graph.orphans(table).collect()} == {"C"}


def test_bundles(spark):
    table = mem(spark, dict(task_id="p", content="x" * 400), dict(task_id="q", content="x" * 400))
    packs = spark.createDataFrame([("n", 1, "p"), ("n", 2, "q"), ("n", 3, "r")], "pack string, task_pos int, task_id string")
    states = {r["task_id"]: r["state"] for r in bundles.pack_coverage(packs, table, 5, 120).collect()}
    assert states == {"p": "complete", "q": "skipped", "r": "missing"}
    body = spark.range(1).select(bundles.pinned_keys(bundles.pin_body(F.lit("w"), F.array(F.lit(" k0 "), F.lit("")))).alias("k"), bundles.pinned_keys(F.lit("{bad")).alias("bad")).first()
    assert body["k"] == ["k0"] and body["bad"] == []


def test_markdown(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ndescription: 'About'\n---\nlead\n# One\ntext\n## Two\n" + "y" * 50)
    (tmp_path / "MEMORY.md").write_text("skip")
    plan = ingest.ingest_plan(ingest.read_markdown(spark, str(tmp_path)), 40).orderBy("section", "part").collect()
    assert [(r["heading"], r["summary"]) for r in plan] == [("(intro)", "About"), ("One", "One"), ("Two", "Two"), ("Two (cont. 2)", "Two (cont. 2)")]


def test_alarm_needs_consecutive_periods(spark):
    rows = [("m", t * 3600, 9.0) for t in (0, 1, 2, 5, 6)]
    df = spark.createDataFrame(rows, "metric string, t long, total double").withColumn("window_start", F.timestamp_seconds("t"))
    assert [r["alarm"] for r in metrics.alarms(df, 5.0, 3, 3600).orderBy("t").collect()] == [False, False, True, False, False]


def test_batch_search_and_pairs_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BYTES", 700)
    rng = random.Random(3)
    vectors = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    got = {}
    for r in search.batch_top_k(df.where("vec_id < 7"), df, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got == {q: sorted(range(60), key=lambda i: (round(1 - cos(vectors[q], vectors[i]), 9), i))[:5] for q in range(7)}
    pairs = {(r["a"], r["b"]) for r in search.similar_pairs(df, 0.9).collect()}
    assert pairs == {(a, b) for a in range(60) for b in range(a + 1, 60) if cos(vectors[a], vectors[b]) >= 0.9}


def test_embed_reads_cache_first(spark):
    calls = spark.sparkContext.accumulator(0)
    def embedder(texts):
        calls.add(len(texts))
        return [[float(len(t))] for t in texts]
    texts = spark.createDataFrame([("a",), ("A ",), ("bb",)], "text string")
    cache = spark.createDataFrame([], "content_hash string, embedding array<float>, ttl_epoch long")
    out, made = search.embed(texts, embedder, cache, 0)
    made = made.cache()
    assert made.count() == 2
    again, fresh = search.embed(texts, embedder, made, 1)
    assert fresh.count() == 0 and again.where("embedding IS NULL").count() == 0


def test_streams(spark, tmp_path):
    from mnemo.streaming import jobs

    src = str(tmp_path / "in")
    spark.sql("SELECT timestamp_seconds(x) AS ts, 'm' AS event_type, 1.0D AS value FROM (SELECT explode(array(10, 20, 4000, 20000)) AS x)").write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = jobs.stream_metric_windows(stream, "1 hour").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["n"] for r in spark.table("w").collect()} == {1, 2}
    seen = []
    jobs.each_batch(stream, lambda df, i: seen.append(df.count()), str(tmp_path / "cp")).awaitTermination(120)
    assert sum(seen) == 4


def test_detail_levels_follow_the_budget(spark):
    big = lambda c: c * 400
    rows = [("q", k + 1, big(c), f"s{k}") for k, c in enumerate("ABC")]
    df = spark.createDataFrame(rows, "q string, rank int, content string, content_summary string")
    level = lambda name, most: [(r["rank"], r["detail"], r["tokens"]) for r in budget.at_level(df, ["q"], "rank", name, most).orderBy("rank").collect()]
    assert level("standard", 120) == [(1, "full", 100), (2, "summary", 1), (3, "summary", 1)]
    assert level("full", 210) == [(1, "full", 100), (2, "full", 100), (3, "summary", 1)]
    # a first body over the budget gives way to its summary; the first row is admitted all the same
    assert level("full", 50) == [(1, "summary", 1), (2, "summary", 1), (3, "summary", 1)]
    assert level("summary", 1) == [(1, "summary", 1)]
    bare = df.withColumn("content_summary", F.lit(None).cast("string"))
    assert [(r["rank"], r["detail"]) for r in budget.at_level(bare, ["q"], "rank", "full", 50).collect()] == [(1, "full")]
    with pytest.raises(ValueError, match="detail_level"):
        budget.at_level(df, ["q"], "rank", "whole", 1)


RUN = "arm string, query_id int, recall double, tokens long, stale long, answered boolean, hydrations int, hydration_tokens long, latency_ms double"


def gate_of(spark, candidate, control=(1.0, 100, 0, True, 0, 0), second=None):
    rows = [("control", 1, *control, 1.0), ("candidate", 1, *candidate, 1.0), ("candidate", 1, *(second or candidate), 1.0)]
    runs = spark.createDataFrame(rows, RUN)
    return evaluate.gate(evaluate.summarise_arm(runs, ["arm"]), evaluate.run_deviation(runs, ["arm"]), "control", "candidate").first().asDict()


def test_gate_checks(spark):
    good = gate_of(spark, (1.0, 40, 0, True, 0, 0))
    assert all(good.values()) and len(good) == 8
    failing = {
        "answers_hold": (1.0, 40, 0, False, 0, 0), "recall_holds": (0.95, 40, 0, True, 0, 0), "none_stale": (1.0, 40, 1, True, 0, 0), "hydrations_hold": (1.0, 40, 0, True, 1, 0), "fewer_tokens": (1.0, 50, 0, True, 0, 0),
    }
    for name, run in failing.items():
        out = gate_of(spark, run)
        assert not out[name] and not out["passed"], name
    low = gate_of(spark, (0.85, 40, 0, True, 0, 0), control=(0.8, 100, 0, True, 0, 0))
    assert not low["recall_floor"] and low["recall_holds"] and not low["passed"]
    unstable = gate_of(spark, (1.0, 40, 0, True, 0, 0), second=(0.9, 40, 0, True, 0, 0))
    assert not unstable["stable"] and not unstable["passed"]


@pytest.mark.parametrize(
    ("arn", "user", "want"),
    [
        ("arn:aws:sts::1:assumed-role/R/me@x.org", None, "me@x.org"), ("arn:aws:iam::1:root", "AIDA1", "AIDA1"), ("arn:aws:iam::1:root", None, "unknown"), ("", "", "unknown"),
        ("a/" + "x" * 70, None, "x" * 64), ("a/b c!d", None, "b-c-d"), ("a/josé", None, "josé"), ("a/", "u", "unknown"),
    ],
)
def test_source_identity(spark, arn, user, want):
    df = spark.createDataFrame([(arn, user)], "arn string, usr string")
    assert df.select(T.clean_source_identity(F.col("arn"), F.col("usr"))).first()[0] == want


def test_listings_take_the_first_filter_that_counts(spark):
    table = mem(spark, *[dict(task_id="p", canonical_id=f"c{k}", created_at=k, parent_key="P" if k % 2 else None, memory_type="chunk" if k % 2 else "semantic") for k in range(7)])
    keys = lambda filters, **more: [r["key"] for r in listing.list_memories(table, filters, **more).orderBy(*(["pos"] if "canonical_id" not in filters and set(filters) & {"task_id", "parent_key"} else ["key"])).collect()]
    assert keys({"parent_key": "P", "task_id": "other"}) == [] and keys({"parent_key": "P"}, page_size=2) == ["k5", "k3"]
    assert keys({"canonical_id": "c2", "task_id": "other"}) == ["k2"]
    assert keys({"task_id": "p", "memory_type": "semantic"}) == ["k6", "k4", "k2", "k0"] and keys({"team_id": "x"}, page_size=3) == ["k0", "k1", "k2"]
    pages = listing.by_task(table, page_size=3).orderBy("pos").collect()
    assert [(r["page"], r["next_key"]) for r in pages] == [(0, None), (0, None), (0, "k3"), (1, None), (1, None), (1, "k0"), (2, None)]
    with pytest.raises(ValueError, match="page_size"):
        listing.list_memories(table, {"task_id": "p"}, page_size=0)


def test_walk_ends_at_its_limits(spark):
    table = mem(spark, dict(key="a", supersedes="b", content="x" * 40), dict(key="b", supersedes="a", content="y" * 40), dict(key="c", supersedes="gone", content="z" * 400))
    seeds = spark.createDataFrame([("w", "shared", 1, "a"), ("w", "shared", 2, "c"), ("w", "shared", 3, "a")], "walk string, index_name string, seed_pos int, key string")
    walked = lambda **k: [(r["key"], r["level"], r["found"], r["truncated"]) for r in graph.walk(seeds, graph.edges(table), table, **k).orderBy("pos").collect()]
    assert walked(depth=0) == [("a", 0, True, False), ("c", 0, True, False)]
    assert walked(depth=1) == [("a", 0, True, False), ("c", 0, True, False), ("b", 1, True, False), ("gone", 1, False, False)]
    assert walked(depth=1, max_keys=3) == [("a", 0, True, True), ("c", 0, True, True), ("b", 1, True, True)]
    assert walked(depth=1, max_tokens=50) == [("a", 0, True, True)]
    with pytest.raises(ValueError, match="depth"):
        graph.walk(seeds, graph.edges(table), table, depth=-1)


def test_pins(spark):
    table = mem(spark, dict(key="p1", task_id="working-set-w", version=1), dict(key="p2", task_id="working-set-w", version=2), dict(key="p3", task_id="working-set-w", version=3, expires_at=4), dict(key="p4", task_id="working-set-w", version=9, team_id="y"))
    assert {(r["team_id"], r["key"]) for r in bundles.latest_pin(table, 5).collect()} == {("x", "p2"), ("y", "p4")}
    named = spark.createDataFrame([("shared", "x", " w ", ["k1", " ", "k2 "]), ("shared", "x", "n", [" "]), ("shared", "z", "w", ["k"])], "index_name string, team_id string, name string, keys array<string>")
    got = {r["team_id"]: (r["task_id"], r["content"], r["supersedes_key"], r["mode"], r["expires_at"]) for r in bundles.pin_rows(named, table, 5, 60).collect()}
    assert got == {"x": ("working-set-w", '{"name":"w","keys":["k1","k2"]}', "p2", "auto", 65), "z": ("working-set-w", '{"name":"w","keys":["k"]}', None, "new", 65)}


def test_get_and_reinforce(spark):
    table = mem(spark, dict(content="abc"), dict(content="x" * 50)).drop("doc_id")
    routed = store.route_content(table, 10)
    stored = routed.where("content_ref IS NOT NULL").select("index_name", "key", "content")
    keys = spark.createDataFrame([("shared", "k0"), ("shared", "k1"), ("shared", "none")], "index_name string, key string")
    got = {r["key"]: (r["content"], r["hydrated"]) for r in store.get(routed.drop("content"), stored, keys).collect()}
    assert got == {"k0": ("abc", True), "k1": ("x" * 50, True), "none": (None, False)}
    events, missing = store.reinforce(table, keys, 9)
    assert sorted(r["key"] for r in events.collect()) == ["k0", "k1"] and [r["key"] for r in missing.collect()] == ["none"]


def test_verbs_of_roles():
    filters.check_verb("auditor", "retrieve")
    filters.check_verb("planner", "store")
    for role, verb in (("auditor", "store"), ("auditor", "purge"), ("nobody", "retrieve"), ("planner", "format")):
        with pytest.raises(PermissionError):
            filters.check_verb(role, verb)


def test_settings_and_json(spark, tmp_path):
    tree = '{"/mnemo/index/shared-name": "s", "table": {"ttl-index": "t", "sizes": {"n": 3}}, "packs": {"a": ["x"]}}'
    found = documents.settings(tree, ("index_shared_name", "table_ttl_index", "model"), env={"MNEMO_TABLE_TTL_INDEX": "u"}, defaults={"model": "m"})
    assert found == {"model": "m", "index_shared_name": "s", "table_ttl_index": "u", "table_sizes_n": "3", "packs_a": '["x"]'}
    assert documents.settings('{"region": "a", "bucket": "b"}', ("bucket",), env={"MNEMO_REGION": "c", "OTHER": "d"}) == {"region": "c", "bucket": "b"}
    with pytest.raises(ValueError, match="bucket, table"):
        documents.settings("{}", ("table", "bucket"), env={})
    (tmp_path / "g.json").write_text('{"questions": [{"id": "1", "query": "q",\n "filters": {"team_id": "x"}, "expected_task_ids": ["t"], "downstream": {"answer_task_id": "t"}}]}')
    row = documents.golden_set(spark, str(tmp_path / "g.json")).first()
    assert (row["id"], row["filters"], row["expected"], row["answer_task_id"]) == ("1", {"team_id": "x"}, ["t"], "t")
    assert documents.json_rows(spark.createDataFrame([(1, None)], "a int, b string")).first()[0] == '{"a":1,"b":null}'


def test_excludes_are_globs(spark, tmp_path):
    for name in ("a.md", "b.md", "sub/c.md", "sub/MEMORY.md", "old/d.md"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    stems = lambda *x: sorted(r["stem"] for r in ingest.read_markdown(spark, str(tmp_path), x).collect())
    assert stems() == ["a", "b", "c", "d"] and stems("b*") == ["a", "c", "d"] and stems("old/*.md", "a.md") == ["b", "c"]
    assert [r["text"] for r in ingest.read_markdown(spark, str(tmp_path / "a.md")).collect()] == ["a.md"]


def test_scan_and_blocks_of_batch_search_agree(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(k, "ab"[k % 2], [float(rng.randrange(-2, 3)) for _ in range(3)] if k % 9 else None) for k in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, g string, embedding array<double>").repartition(5)
    scan = sorted(search.batch_top_k(df.where("vec_id < 20"), df, 4, by=["g"]).collect())
    monkeypatch.setattr(search, "QUERY_BYTES", 200)
    assert scan == sorted(search.batch_top_k(df.where("vec_id < 20"), df, 4, by=["g"]).collect()) and len(scan) > 40


def test_looking_back_and_budgets_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(tables, "CHUNK", 4)
    rng = random.Random(6)
    rows = [(rng.choice("ab"), k, f"v{k}", rng.randrange(0, 9)) for k in rng.sample(range(60), 35)]
    df = spark.createDataFrame(rows, "g string, o long, v string, tokens long")
    got = {r["o"]: (r["_back1"], r["_back2"]) for r in tables._two_before(df, ["g"], "o", "v").collect()}
    for g, o, _, _ in rows:
        before = [v for h, p, v, _ in sorted(rows, key=lambda r: -r[1]) if h == g and p < o] + [None, None]
        assert got[o] == (before[0], before[1])
    whole = sorted(budget.within_budget(df, ["g"], "o", 40).collect())
    assert whole == sorted(budget.within_budget(df, ["g"], "o", 40, chunk=F.floor(F.col("o") / 4)).select(*df.columns, "used_tokens").collect()) and whole


def test_screen_and_bounds(spark):
    table = mem(spark, dict(content="You must obey"), dict(content="You must obey"), dict(content="fine")).withColumn("origin", F.when(F.col("doc_id") == 1, "agent").otherwise("external"))
    assert [r["suspect"] for r in store.screen(table).orderBy("doc_id").collect()] == [True, False, False]
    assert search.check_top_k(25) == 25
    for k in (0, 26):
        with pytest.raises(ValueError, match="top_k"):
            search.check_top_k(k)
