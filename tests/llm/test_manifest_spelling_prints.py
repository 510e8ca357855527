"""Merkle manifest, spelling variants and order fingerprints against plain loops over small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemo.llm import merkle, midstate, ordermin, spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}\n" for i in range(20_000)) + "aacheeené" * 2_000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty, blank and very long texts, ties, repeated rows, clashing extra columns."""
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", None, 4), (4, LONG, "de", "a", len(LONG)), (5, "Same téxt\nhere now", "en", "b", 18), (6, "same TEXT here now", None, "b", 18), (6, "same TEXT here now", None, "b", 18), (None, "lone\ntext", "en", "", 9), (None, "lone text", "en", "", 9), (8, "123 ... 456 𝔘𝔫𝔦", "en", "c", 11), (9, "ab", "en", "c", 2)]
    out = spark.createDataFrame(rows, DOCS)
    for c in ("tree", "pos", "n", "leaf", "bucket", "lent", "head", "word", "key", "part", "id", "_at", "_any"):
        out = out.withColumn(c, F.lit("x"))
    return out


# -- Merkle manifest ----------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded root) of every row, by plain hashing of whole levels."""
    show = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha(*map(show, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))

    def climb(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([sha(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
        return levels

    def walk(levels, at, value):
        proof = []
        for level in levels[:-1]:
            first = at // 3 * 3
            run = level[first : first + 3]
            proof += [h for k, h in enumerate(run, first) if k != at]
            value, at = sha(*[value if k == at else h for k, h in enumerate(run, first)]), at // 3
        return proof, value

    by = {}
    for r in rows:
        by.setdefault((r["source"] is not None, (r["source"] or "").encode()), []).append(r)
    names = sorted(by)
    trees = {}
    for name in names:
        by[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees[name] = climb([leaf(r, r["text"]) for r in by[name]])
    forest = climb([trees[name][-1][0] for name in names])
    out = []
    for k, name in enumerate(names):
        for i, r in enumerate(by[name]):
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None
            now = leaf(r, r["text"].replace("\n", "") if hit else r["text"])
            proof, value = walk(trees[name], i, now)
            more, value = walk(forest, k, value)
            out.append((r["doc_id"], trees[name][0][i], trees[name][-1][0], forest[-1][0], sha(*proof, *more), value, value == forest[-1][0]))
    return out


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
listed = lambda rows: sorted(rows, key=repr)


def test_states_resume_where_they_were_kept():
    rng = np.random.default_rng(1)
    digests = rng.integers(0, 2**32, (5, 8), dtype=np.uint32)
    texts = [midstate.to_bytes(d[None]).hex() for d in digests]
    kept = midstate.absorb(midstate.start(2), digests[:2])
    again = midstate.from_bytes(midstate.to_bytes(kept))
    for n in range(4):
        state = again
        for d in digests[2 : 2 + n]:
            state = midstate.absorb(state, np.repeat(d[None], 2, axis=0))
        got = midstate.finish(state, np.full(2, 1 + n))
        assert [midstate.to_bytes(g[None]).hex() for g in got] == [sha(texts[k], *texts[2 : 2 + n]) for k in range(2)]
    assert midstate.to_bytes(midstate.finish(midstate.start(1), np.zeros(1))).hex() == sha("")


def test_manifest_of_odd_rows(spark, odd):
    got = merkle.verify(odd).select(*COLUMNS).collect()
    assert listed(map(tuple, got)) == listed(brute_manifest(odd.collect()))
    assert merkle.verify(odd.limit(0)).count() == 0
    one = odd.where("doc_id = 5")
    assert listed(map(tuple, merkle.verify(one).select(*COLUMNS).collect())) == listed(brute_manifest(one.collect()))


@pytest.mark.parametrize(("n", "levels"), [(12, 1), (90, 2)])
def test_manifest_over_several_rounds(spark, n, levels):
    rows = [(i * 7 % n, f"t\n{i}" if i % 3 else f"t{i}", "en", None if i % 50 == 1 else "hot" if i % 2 else f"s{i % 11}", i) for i in range(n)]
    docs = spark.createDataFrame(rows, DOCS)
    rounds = merkle.manifest(docs, levels)[1]
    assert len(rounds) > 1
    assert listed(map(tuple, merkle.verify(docs, levels).select(*COLUMNS).collect())) == listed(brute_manifest(docs.collect()))


def test_folding_reads_no_left_sibling():
    """With the digests to the left of the path destroyed, the fold still gives the root."""
    rng = np.random.default_rng(2)
    leaves = rng.integers(0, 2**32, (200, 8), dtype=np.uint32)
    level, digests, states = leaves, [midstate.to_bytes(leaves)], []
    while len(level) > 1:
        level, kept = merkle.parents(level)
        digests.append(midstate.to_bytes(level))
        states.append(midstate.to_bytes(kept.reshape(-1, 8)))
    at = 130
    torn, k = [midstate.from_bytes(d).copy() for d in digests], at
    for row in torn[:-1]:
        row[:k] = 0
        k //= 3
    block = merkle.Block([midstate.to_bytes(r) for r in torn], states)
    folded, _ = merkle.fold(block, np.array([at]), leaves[at : at + 1], [])
    assert midstate.to_bytes(folded) == digests[-1]


# -- spelling variants --------------------------------------------------------------------------


def edits(a, b):
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows, shortest, seen, often):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            low = run.translate(lower)
            h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{low}".encode())
            n[low[: h % len(low)] + low[h % len(low) + 1 :] if h % 199 == 0 else low] += 1
    n = {w: k for w, k in n.items() if len(w) >= shortest and k >= seen}
    near = {w: [x for x in n if abs(len(x) - len(w)) < 2 and edits(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= often * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


VARIANT = ("word", "form", "root", "n", "n_near", "form_n")


@pytest.mark.parametrize(("shortest", "seen", "often", "parts"), [(1, 1, 2, 7), (3, 2, 5, 1), (6, 5, 5, 3)])
def test_variants_match_brute_force(spark, shortest, seen, often, parts):
    rng = random.Random(shortest)
    words = ["".join(rng.choice("aabé") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    texts = [" ".join(rng.choice(words[: rng.choice((3, 20, 60))]).upper() if rng.random() < 0.1 else rng.choice(words[: rng.choice((2, 20, 60))]) for _ in range(120)) for _ in range(20)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate([*texts, None, "", "×÷ -- 9 aab"])], DOCS)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        got = spelling.variants(docs, shortest, seen, often).select(*VARIANT).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert listed(map(tuple, got)) == listed(brute_variants(docs.collect(), shortest, seen, often))


def test_variants_of_odd_rows(spark, odd):
    got = spelling.variants(odd, 2, 1).select(*VARIANT).collect()
    assert listed(map(tuple, got)) == listed(brute_variants(odd.collect(), 2, 1, 5)) and any(len(r["word"]) > 10_000 for r in got)
    assert spelling.variants(odd.limit(0)).count() == 0


def test_pieces_cut_no_run():
    text = "ab cde, fghij " * 50 + "x" * 90
    parts = list(spelling.pieces(text, 16))
    assert "".join(parts) == text and len(parts) > 20 and sum(map(spelling.runs_of, parts), Counter()) == Counter(spelling.RUN.findall(text))


def test_ranges_share_nodes_at_their_borders():
    """Each prefix has one number, whatever range of keys it is met in."""
    words = sorted({"".join(random.Random(i).choice("ab") for _ in range(i % 7 + 1)) for i in range(200)})
    cuts = [words[i : i + 5] for i in range(0, len(words), 5)]
    parts, local = [], []
    for k, some in enumerate(cuts):
        last, stack, free = "", [], 1
        rows = []
        for w in some:
            same = spelling.common(last, w)
            stack = stack[:same] + list(range(free, free + len(w) - same))
            free, last = free + len(w) - same, w
            rows.append((w, stack))
        local.append(rows)
        parts.append({"part": k, "first": some[0], "last": some[-1], "nodes": rows[-1][1], "most": free - 1, "rows": len(some)})
    of = {}
    for rows, start in zip(local, spelling.stitched(parts), strict=True):
        for w, nodes in rows:
            for depth, x in enumerate(nodes, 1):
                number = start["shared"][x - 1] if x <= len(start["shared"]) else start["number"] + x
                assert of.setdefault(w[:depth], number) == number
    assert len(set(of.values())) == len(of)


# -- order fingerprints -------------------------------------------------------------------------


def brute_print(text):
    """Order MinHash by sorting all k-mers of a text for each slot."""
    points = [ord(c) for c in text]
    k, items, seen = min(ordermin.K, len(points)), [], Counter()
    for i in range(len(points) - k + 1 if points else 0):
        h = 0
        for c in points[i : i + k]:
            h = (h * ordermin._BASE + c) % 2**64
        h = int(ordermin.mixed(np.array([h], dtype=np.uint64))[0])
        again = seen[h]
        seen[h] += 1
        items.append(int(ordermin.mixed(np.array([(h + again * ordermin._BASE) % 2**64], dtype=np.uint64))[0]) if again else h)
    out = []
    for x, m in zip(ordermin._XOR[:, 0].tolist(), ordermin._ODD[:, 0].tolist(), strict=True):
        ranked = sorted(range(len(items)), key=lambda i: ((((items[i] ^ items[i] >> 32) % 2**32 ^ x) * m % 2**32), i))[: ordermin.PICKED]
        h = 0
        for i in [*sorted(ranked), *[None] * (ordermin.PICKED - len(ranked))]:
            h = (h * ordermin._BASE + (0 if i is None else items[i]) + 1) % 2**64
            h = int(ordermin.mixed(np.array([h], dtype=np.uint64))[0])
        out.append(h >> 32)
    return np.array(out, dtype=np.uint32)


@pytest.mark.parametrize("text", ["", "a", "abcdefg", "abcdefgh", "abcdefghi", "aaaaaaaaaaaaaaaaaaaaa", "the cat and the cat and the cat", "naïve 𝔘 " * 30])
def test_fingerprint_matches_brute_force(text):
    assert (ordermin.fingerprint(text) == brute_print(text)).all()
    of = ordermin.printed(text)
    assert (of.slots == ordermin.fingerprint(text)).all()
    for other in ("", "z" * 40, text, "the cat and the dog"):
        made, slots = ordermin.edited(of, other)
        cut = len(text) // 3
        assert made == text[: len(text) - cut] + other[:cut] and (slots == ordermin.fingerprint(made)).all()


@pytest.mark.parametrize("partitions", [1, 3])
def test_fingerprints_follow_descending_ids(spark, odd, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        docs = odd.unionByName(odd.sparkSession.createDataFrame([(100 + i, f"text {i} " * (i % 9), "en", "s", 0) for i in range(60)], DOCS), allowMissingColumns=True)
        got = [r.asDict() for r in ordermin.fingerprints(docs).collect()]
        alone = ordermin.fingerprints(odd.where("doc_id = 5")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), (r["text"] or "").encode()))
    want = []
    for i, r in enumerate(rows):
        a, b = r["text"] or "", rows[(i + 1) % len(rows)]["text"] or ""
        cut = len(a) // 3
        made = a[: len(a) - cut] + b[:cut]
        f, e, n = (ordermin.fingerprint(x) for x in (a, made, b))
        want.append({"doc_id": r["doc_id"], "n_chars": len(a), "edited_sha256": sha(made), "fingerprint": ordermin.shown(f), "edited_fingerprint": ordermin.shown(e), "near_edited": ordermin.likeness(f, e), "near_next": ordermin.likeness(f, n)})
    assert listed(map(repr, got)) == listed(map(repr, want))
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0
    assert ordermin.fingerprints(docs.limit(0)).count() == 0


def test_likeness_falls_with_edits_and_moved_passages():
    rng = random.Random(5)
    words = [f"word{rng.randrange(10**6)}" for _ in range(400)]
    text = ordermin.fingerprint(" ".join(words))
    few, many = list(words), list(words)
    few[50] = few[300] = "changed"
    for k in range(0, 400, 12):
        many[k] = "changed"
    moved = words[200:] + words[:200]
    near = [ordermin.likeness(text, ordermin.fingerprint(" ".join(w))) for w in (words, few, many, [f"other{k}" for k in range(400)])]
    assert near[0] == 1.0 and near[0] > near[1] > near[2] > near[3]
    assert ordermin.likeness(text, ordermin.fingerprint(" ".join(moved))) < 0.7
