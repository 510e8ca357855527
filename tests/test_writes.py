"""Batches of writes against a loop that takes them one by one."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemo.operators import access, bundles, ingest, search, writes

MEM = "index_name string, task_id string, key string, content_hash string, embedding array<double>, status string, version int"
ROWS = "seq long, index_name string, task_id string, agent_id string, embedding array<double>, content_hash string, supersedes_key string, mode string"


def one_by_one(rows, mem, near=0.95, top=5):
    """What a writer that stores each row before it reads the next would answer."""
    unit = lambda v: None if v is None or not np.any(v) else np.asarray(v) / np.linalg.norm(v)
    live = [dict(m) for m in mem if m["status"] == "active"]
    version = {(m["index_name"], m["key"]): m["version"] for m in mem}
    out = {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        around = [m for m in live if (m["index_name"], m["task_id"]) == (r["index_name"], r["task_id"])]
        same = sorted(m["key"] for m in around if m["content_hash"] == r["content_hash"])
        x, close = unit(r["embedding"]), []
        for m in around:
            y = unit(m["embedding"])
            if x is not None and y is not None:
                d = round(1 - float(x @ y), 9)
                if 1 - d >= near:
                    close.append((d, m["key"]))
        keys = [k for _, k in sorted(close)[:top]]
        old = r["supersedes_key"]
        if same:
            out[r["seq"]] = ("unchanged", same[0], [])
            continue
        if old:
            out[r["seq"]] = ("superseded", old, [])
            live = [m for m in live if (m["index_name"], m["key"]) != (r["index_name"], old)]
        elif r["mode"] != "new" and keys:
            out[r["seq"]] = ("duplicate_detected", keys[0], keys)
            continue
        else:
            out[r["seq"]] = ("created", None, [])
        v = version[r["index_name"], old] + 1 if old else 1
        live.append({**r, "key": f"mem_{r['agent_id']}_{r['task_id']}_{r['content_hash'].split(':')[1][:16]}_v{v}"})
    return out


def made(seed, n, stored, tasks, angles, supersede):
    """Vectors on a circle, so that near rows form chains; contents repeat along with their vectors."""
    rng = random.Random(seed)
    vector = lambda a: [float(np.cos(a)), float(np.sin(a)), 0.0]
    mem = [("shared", f"t{rng.randrange(tasks)}", f"mem_a_k{i}_v1", f"sha256:s{rng.randrange(30):016d}", vector(rng.random() * angles), rng.choice(["active", "active", "archived"]), rng.randint(1, 3)) for i in range(stored)]
    rows = []
    for i in range(n):
        c = rng.randrange(3 * n // 2)
        target = rng.choice(mem) if mem and rng.random() < supersede else None
        rows.append((i, "shared", target[1] if target else f"t{rng.randrange(tasks)}", "a", None if rng.random() < 0.03 else vector(random.Random(c).random() * angles), f"sha256:c{c:016d}", target[2] if target else None, rng.choice(["auto", "auto", None, "new"]) if not target else "auto"))
    return rows, mem


@pytest.mark.parametrize(("seed", "n", "stored", "tasks", "angles", "supersede"), [(1, 60, 20, 2, 6.0, 0.0), (2, 80, 12, 1, 20.0, 0.3), (3, 40, 0, 3, 1.0, 0.0), (4, 1, 0, 1, 1.0, 0.0)])
def test_batch_equals_one_by_one(spark, seed, n, stored, tasks, angles, supersede):
    rows, mem = made(seed, n, stored, tasks, angles, supersede)
    names = lambda schema: [c.split()[0] for c in schema.split(", ")]
    want = one_by_one([dict(zip(names(ROWS), r, strict=True)) for r in rows], [dict(zip(names(MEM), m, strict=True)) for m in mem])
    got = writes.classify(spark.createDataFrame(rows, ROWS), spark.createDataFrame(mem, MEM)).collect()
    assert {r["seq"]: (r["action"], r["match_key"], r["near_keys"]) for r in got} == want


def test_chain_of_near_copies_in_parts(spark, monkeypatch):
    """Each row is near its two neighbours only: every second one is created; base rows are broadcast in many parts."""
    monkeypatch.setattr(search, "QUERY_BYTES", 300)
    rows = [(i, "shared", "t", "a", [float(np.cos(0.3 * i)), float(np.sin(0.3 * i))], f"sha256:{i:016d}", None, None) for i in range(9)]
    got = {r["seq"]: r["action"] for r in writes.classify(spark.createDataFrame(rows, ROWS), spark.createDataFrame([], MEM)).collect()}
    assert [got[i] for i in range(9)] == ["created", "duplicate_detected"] * 4 + ["created"]
    assert writes.classify(spark.createDataFrame([], ROWS), spark.createDataFrame([], MEM)).count() == 0


def test_copies_of_a_crowd_take_few_rounds(spark, monkeypatch):
    rounds = []
    plain = writes.scan
    monkeypatch.setattr(writes, "scan", lambda *a, **k: rounds.append(1) or plain(*a, **k))
    rows = spark.range(400).select(F.col("id").alias("seq"), F.lit("shared").alias("index_name"), F.lit("t").alias("task_id"), F.lit("a").alias("agent_id"), F.array(F.lit(1.0), F.col("id") * 1e-5).alias("embedding"), F.concat(F.lit("sha256:"), F.col("id") % 40).alias("content_hash"), F.lit(None).cast("string").alias("supersedes_key"), F.lit("auto").alias("mode"))
    got = writes.classify(rows, spark.createDataFrame([], MEM)).groupBy("action").count().collect()
    assert {r["action"]: r["count"] for r in got} == {"created": 1, "unchanged": 9, "duplicate_detected": 390} and len(rounds) <= 4


def test_registries_are_checked(spark):
    assert bundles.registry(" ") == {} and bundles.registry('{"a": ["x", "y"]}') == {"a": ["x", "y"]}
    for bad in ("{", "[1]", '{"a": "x"}', '{"a": [1]}'):
        with pytest.raises(ValueError):
            bundles.registry(bad)
    rows = bundles.named(spark, {"a": ["x", "y", "x"], "b": ["z"]}, ["a"]).collect()
    assert [(r["pack"], r["task_pos"], r["task_id"]) for r in rows] == [("a", 1, "x"), ("a", 2, "y")]
    with pytest.raises(ValueError, match="known: a"):
        bundles.named(spark, {"a": []}, ["c"])


def test_requests_are_answered_with_errors_as_data(spark):
    mem = spark.createDataFrame([("shared", "k1", "active", 2), ("private-a", "k2", "active", 1)], "index_name string, key string, status string, version int")
    asked = [(1, "a", "planner", "get", None, "k1"), (2, "a", "planner", "get", "private-b", "k1"), (3, "a", "auditor", "store", None, None), (4, "a", None, "get", None, "k1"), (5, "a", "planner", "get", "private-a", "k9"), (6, "a", "planner", "list", None, None), (7, "a", "planner", None, None, "k1")]
    got = {r["request_id"]: (r["error_type"], r["status"], r["index_name"]) for r in access.dispatch(spark.createDataFrame(asked, "request_id int, agent_id string, role string, verb string, index_name string, key string"), mem).collect()}
    assert got == {1: (None, "active", "shared"), 2: ("index", None, "private-b"), 3: ("verb", None, "shared"), 4: ("role", None, None), 5: ("key", None, "private-a"), 6: (None, None, "shared"), 7: ("verb", None, "shared")}


def plain_chunks(text, most):
    """The rules of the markdown cut, by one text at a time."""
    text = text.strip()
    heads = list(re.finditer(r"^(#{1,3}) +(.+)$", text, re.M))
    found = [("(whole file)", text)] if text and not heads else []
    if heads and text[: heads[0].start()].strip():
        found.append(("(intro)", text[: heads[0].start()].strip()))
    for i, m in enumerate(heads):
        found.append((m[2].strip(), text[m.start() : heads[i + 1].start() if i + 1 < len(heads) else len(text)].strip()))
    return [(h if j == 0 else f"{h} (cont. {j // most + 1})", body[j : j + most]) for h, body in found for j in range(0, len(body), most)]


def test_markdown_cut_follows_its_rules(spark):
    rng = random.Random(8)
    bits = ["# One", "## Two ", "###  ", "#### four", "#no", "text", "", " ", "\t", "  ", "é𝔘 long line " * 4, "## A\r", " ## indented", "#   "]
    texts = ["", "\n\n", "\n \n# H\nbody\n\n", "plain", "\x1c# H\x1c"] + ["\n".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got: dict = {}
    for r in ingest.chunk_markdown(df, "id", "text", 25).orderBy("section", "part").collect():
        got.setdefault(r["id"], []).append((r["heading"], r["content"]))
    assert {i: c for i, t in enumerate(texts) if (c := plain_chunks(t, 25))} == got


def test_files_of_one_stem_and_summaries(spark):
    rows = [("a/notes.md", "notes", "\n\n# One\nfirst"), ("b/notes.md", "notes", "---\ndescription: \"'About'\"\n---\n#\n\n## \n\n>  Some   *words*\nhere"), ("c/x.md", "x", "---\nname: y\n---\n## \n\nbody"), ("d/y.md", "y", "no heading\nat all\n\nmore")]
    plan = ingest.ingest_plan(spark.createDataFrame(rows, "path string, stem string, text string"), 100).orderBy("path", "section").collect()
    got = [(r["path"], r["task_id"], r["heading"], r["summary"]) for r in plan]
    assert got[0] == ("a/notes.md", "notes", "One", "One") and got[1][:3] == ("b/notes.md", "notes", "(whole file)") or got[1][0] == "b/notes.md"
    assert [g[3] for g in got if g[0] == "d/y.md"] == ["no heading at all"] and all(g[3] for g in got) and len({(r["path"], r["section"], r["part"]) for r in plan}) == len(plan)
