"""The training-data operators against brute force, round trips and held-out accuracy on small tables."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemo.llm import common, crosspoly, dedup, graph, jaccard, langid, mixing, packing, pii, sepscan, shingles, warc, wrapper

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))


def table(spark, texts, langs=None, sources=None):
    rows = [(i, t, (langs or ["en"] * len(texts))[i], (sources or ["s"] * len(texts))[i], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, vocabulary=400):
    return " ".join(f"t{rng.randint(0, vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty, blank and very long texts, ties, repeated rows, a clashing extra column."""
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", None, 4), (4, LONG, "de", "a", len(LONG)), (5, "Same text here now", "en", "b", 18), (6, "same TEXT here now", None, "b", 18), (6, "same TEXT here now", None, "b", 18), (None, "lone text", "en", "", 9), (8, "123 ... 456", "en", "c", 11)]
    return spark.createDataFrame(rows, DOCS).withColumn("digest", F.lit("x")).withColumn("rep", F.lit(1)).withColumn("token", F.lit(2)).withColumn("size", F.lit(0))


# -- exact dedup --------------------------------------------------------------------------------


def test_dedup_matches_brute_force(spark, odd):
    got = dedup.exact_dedup(odd, runs=8).collect()
    rows = odd.select("doc_id", "text").collect()
    low = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    by = {}
    for r in rows:
        by.setdefault(low(r["text"]), []).append(r["doc_id"])
    assert len(got) == len(rows)
    for r in got:
        text = next(t for t, ids in by.items() if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        known = [i for i in by[text] if i is not None]
        assert r["keep_id"] == (max(known) if known else None) and r["group_size"] == len(by[text]) and r["kept"] == (r["doc_id"] == r["keep_id"])
    assert dedup.exact_dedup(odd.limit(0)).count() == 0
    clash = odd.withColumn("_id", F.lit(1)).withColumn("_digest", F.lit("d")).withColumn("_row", F.lit(0)).withColumn("_n", F.lit(0))
    kept = dedup.kept_documents(clash, runs=8)
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 2, 3, 4, 6, 8] and kept.columns == clash.columns
    assert dedup.kept_documents(odd.limit(0)).count() == 0
    accents = dedup.exact_dedup(table(spark, ["É a", "é a", "É A"])).orderBy("doc_id").collect()
    assert [r["keep_id"] for r in accents] == [2, 1, 2]


def test_dedup_merges_sorted_runs_sixteen_at_a_time(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("one text")).otherwise(F.concat(F.lit("t"), F.col("id") % 1500)).alias("text"))
    prints = dedup.in_runs(dedup.fingerprints(docs), 300)
    levels = dedup.tree_merge(prints, 300, "min")
    leaves, root = levels[0], levels[-1]
    assert len(levels) == 4 and [x.select("run").distinct().count() for x in levels] == [300, 19, 2, 1]
    assert leaves.groupBy("run", "digest").count().where("count > 1").isEmpty() and leaves.where("group_size > 1").count() > 200
    told = dedup.verdicts(levels)
    assert told.count() == leaves.count() and told.where("keep_id = 0 AND group_size = 1000").count() == leaves.join(root.where("keep_id = 0").select(*dedup.KEY), dedup.KEY, "left_semi").count()
    top = root.orderBy(F.desc("group_size")).first()
    assert (top["keep_id"], top["group_size"]) == (0, 1000) and root.count() == 1001 and root.agg(F.sum("group_size")).first()[0] == 3000
    plan = root._jdf.queryExecution().executedPlan().toString()
    assert "Window [" in plan and "Sort [run" in plan and "Python" not in plan
    assert [dedup.runs_for(n) for n in (0, 20_000, 250_000, 10**9)] == [2, 2, 16, 65536]


# -- n-gram Jaccard join ------------------------------------------------------------------------


def brute_components(texts, width, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    label = list(range(len(texts)))
    changed = True
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return [len(s) for s in sets], label


def near_copies(rng, n, groups):
    texts = []
    for _ in range(groups):
        base = words(rng, rng.randint(3, 120), 50_000).split()
        for _ in range(rng.randint(1, n)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 10**6)}"
            texts.append(" ".join(copy))
    return texts + ["common line of words"] * 3 + ["common line of words again", "", None, "a", "a", "A b"]


@pytest.mark.parametrize(("width", "percent", "crowd", "listed"), [(3, 90, 64, 32), (5, 80, 64, 32), (3, 90, 2, 32), (2, 70, 3, 32), (3, 90, 64, 3), (5, 80, 3, 3)])
def test_jaccard_components_match_brute_force(spark, monkeypatch, width, percent, crowd, listed):
    monkeypatch.setattr(jaccard, "RARE", crowd)
    monkeypatch.setattr(jaccard, "LISTED_COUNT", listed)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 4)
    texts = near_copies(random.Random(width * percent + crowd), 12, 14)
    sizes, label = brute_components(texts, width, percent)
    got = jaccard.join_components(table(spark, texts), width, percent).orderBy("doc_id").collect()
    assert [r["n_shingles"] for r in got] == sizes
    assert [r["component_id"] for r in got] == label


@pytest.mark.parametrize("percent", [70, 80, 90, 95])
def test_linked_sets_without_a_rare_token_in_common_share_a_combination(percent):
    rng = np.random.default_rng(percent)
    for n in [*range(jaccard.least_size(percent), 60), 97, 300, 1000, 5000]:
        for _ in range(6):
            a = rng.integers(1, 1 << 63, n, dtype=np.uint64)
            m = int(rng.integers(-(-percent * n // 100), 100 * n // percent + 1))
            least = jaccard.shared_least(n, m, percent)
            if least > min(n, m):
                continue
            own = int(rng.integers(0, n - least + 1))  # rare tokens of the first; the second has none
            b = np.concatenate([a[:least], rng.integers(1, 1 << 63, m - least, dtype=np.uint64)])
            entries = []
            for s, rare in ((a[: n - own], own), (b, 0)):
                size = len(s) + rare
                count = min(size, size - -(-percent * size // 100) + 2)
                order = np.sort(s)
                entries.append(set(jaccard.combined(order, size, rare, max(0, count - rare), percent).tolist()))
            assert entries[0] & entries[1], (n, m, least, own)
            assert len(entries[0]) < 4 * n + 100


def test_jaccard_odd_rows(spark, odd):
    rows = jaccard.join_components(odd, 3, 90).collect()
    assert len(rows) == odd.count()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (0, 3) and got[5] == (2, 5) and got[6] == (2, 5)
    assert jaccard.join_components(odd.limit(0), 3, 90).count() == 0
    assert {r["doc_id"] for r in jaccard.one_of_each(odd.where("doc_id IN (5, 6)"), 3, 90).collect()} == {5}


def test_shingles_of_long_words_and_segments(monkeypatch):
    text = " ".join(["ab", "c" * 700, "d", "é" * 300] * 40) + " A B"
    whole = next(shingles.shingle_sets([text], 3))
    monkeypatch.setattr(shingles, "_SEGMENT", 256)
    cut = next(shingles.shingle_sets([text], 3))
    w = text.lower().split()
    assert len(whole) == len(cut) == len({tuple(w[i : i + 3]) for i in range(len(w) - 2)})


def test_components_of_long_chains(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1001), (2000, 2000)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got[i] for i in range(301)} == {0} and got[1001] == 1000 and 2000 not in got


# -- packing, token counts ----------------------------------------------------------------------


def test_packing_places_every_token_once(spark, odd):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    rng = random.Random(4)
    docs = table(spark, [None, "", "it's 12 o'clock, İstanbul ÉÀ ΟΔΟΣ", LONG, *[words(rng, rng.randint(1, 900)) for _ in range(60)]])
    rows = packing.pack(docs).collect()
    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r["doc_id"]: [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    at = {i: 0 for i in ids}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == at[r["doc_id"]] and len(piece) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes())
        at[r["doc_id"]] += r["length"]
    assert all(at[i] == len(ids[i]) for i in ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048
    assert sorted(sequences) == list(range(len(sequences)))
    assert packing.pack(docs.limit(0)).count() == 0
    assert packing.pack(odd).agg(F.countDistinct("doc_id")).first()[0] == 7


def test_ids_are_the_library_s_on_any_text():
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    from mnemo.llm.tokens import WordTokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    mine, theirs = WordTokenizer(path), tokenizers.Tokenizer.from_file(path)
    assert mine.by_word
    rng = random.Random(12)
    ranges = [(32, 127), (160, 0x250), (0x300, 0x370), (0x370, 0x600), (0x900, 0xE80), (0x1C80, 0x2070), (0x2C00, 0x3100), (0xA640, 0xAC10), (0xFB00, 0x10000), (0x10400, 0x10500), (0x1E900, 0x1E960)]
    texts = ["DENİZLİ.", "İ!", "İ, İ. ΟΔΟΣ. ΟΔΟΣ? Σ, ǅ. ŉ! ß? ﬁ, 'S. it's, don't! e\u0301. \u0345,"]
    for _ in range(4000):
        letters = [chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randrange(1, 12))]
        texts.append("".join(c for c in letters if not 0xD800 <= ord(c) < 0xE000) + rng.choice(["", ".", ",", "!", "? İ.", ".."]))
    wrong = [t for t, ids in zip(texts, mine.ids_of(texts), strict=True) if list(np.frombuffer(ids, "<u4")) != theirs.encode(t, add_special_tokens=False).ids]
    assert not wrong, wrong[:5]


def test_plan_uses_each_length_exactly_and_wastes_little():
    rng = np.random.default_rng(0)
    histogram = np.bincount(np.minimum(rng.exponential(500, 20_000).astype(int) + 1, 2048), minlength=2049)
    packs = packing.plan_packs(histogram, 2048)
    used = np.zeros_like(histogram)
    for lengths, n in packs:
        assert sum(lengths) <= 2048 and n > 0
        for x in lengths:
            used[x] += n
    assert (used == histogram).all()
    held = sum(sum(lengths) * n for lengths, n in packs)
    assert held / (2048 * sum(n for _, n in packs)) > 0.99


def test_badly_fitting_lengths_are_cut_again(spark):
    docs = table(spark, [" ".join(["the"] * 1100)] * 40)
    rows = packing.pack(docs)
    assert rows.agg(F.countDistinct("sequence_id")).first()[0] <= 23


def test_nnls_matches_known_solution():
    columns = np.array([[0, 1, -1], [2, -1, -1], [0, 2, -1]])
    x = packing.nnls(columns, 3, np.array([5.0, 5.0, 2.0]), np.ones(3))
    assert np.allclose(x, [5, 2, 0], atol=1e-8)


def test_separator_scan_across_blocks(spark, tmp_path, odd):
    rng = np.random.default_rng(1)
    want = {}
    for k, n in enumerate((0, 1, 37, 5000)):
        ids = rng.integers(0, 50, n).astype("<u2")
        (tmp_path / f"f{k}.bin").write_bytes(ids.tobytes())
        docs, start = [], 0
        for i, x in enumerate(ids):
            if x == 0:
                docs.append((start, i - start, True))
                start = i + 1
        want[f"f{k}.bin"] = docs + ([(start, n - start, False)] if start < n else [])
    got = {}
    for r in sepscan.scan(spark, str(tmp_path), separator=0, block_tokens=7).orderBy("file", "ordinal").collect():
        got.setdefault(r["file"], []).append((r["start"], r["n_tokens"], r["terminated"]))
    assert got == {k: v for k, v in want.items() if v}
    pytest.importorskip("tiktoken")
    counts = sepscan.token_counts(odd).collect()
    encoder = sepscan.byte_encoder()
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in counts) == sorted((r["doc_id"] or -1, len(encoder.encode_ordinary(r["text"] or ""))) for r in odd.collect())
    assert sepscan.token_counts(odd.limit(0)).count() == 0


def test_one_of_each_tells_rows_of_one_identifier_apart(spark):
    rng = random.Random(5)
    a, b, c = (words(rng, 60, 10_000) for _ in range(3))
    rows = [(1, a, "en", "s", 1), (2, a + " end", "en", "s", 1), (2, b, "en", "s", 1), (None, c, "en", "s", 1), (None, c + " end", "en", "s", 1), (9, b + " end", "en", "s", 1)]
    got = jaccard.one_of_each(spark.createDataFrame(rows, DOCS)).collect()
    assert {(r["doc_id"], r["text"]) for r in got if r["doc_id"]} == {(1, a), (2, b)}
    assert len(got) == 3 and [r["text"] in (c, c + " end") for r in got if r["doc_id"] is None] == [True]


# -- mixing -------------------------------------------------------------------------------------


def water_fill(sizes, total, weights, cap):
    target = {s: 0.0 for s in sizes}
    excess, free = total, [s for s in sizes if sizes[s]]
    while excess > 1e-9 and free:
        w = sum(weights[s] for s in free)
        for s in free:
            target[s] += excess * weights[s] / w
        excess = sum(max(0, target[s] - cap * sizes[s]) for s in free)
        for s in free:
            target[s] = min(target[s], cap * sizes[s])
        free = [s for s in free if target[s] < cap * sizes[s] - 1e-9]
    return target


def test_mix_meets_targets(spark):
    rng = random.Random(6)
    sources = [rng.choice(["a", "a", "a", "b", "c", None, "é", "Z"]) for _ in range(400)]
    docs = table(spark, [words(rng, rng.randint(0, 120)) for _ in sources], sources=sources)
    documents, uses = mixing.mix(docs, block=16, shard_slots=64, slack=0.0)
    rows, again = documents.collect(), mixing.mix(docs.repartition(7), block=16, shard_slots=64, slack=0.0)[0].collect()
    key = lambda r: (r["doc_id"], r["size"], r["taken"], r["target"])
    assert sorted(map(key, rows)) == sorted(map(key, again)) and len(rows) == 400
    of = dict(enumerate(sources))
    sizes = {s: sum(r["size"] for r in rows if of[r["doc_id"]] == s) for s in set(sources)}
    ranked = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water_fill(sizes, 1.5 * sum(sizes.values()), {s: (3, 1, 2)[k % 3] for k, s in enumerate(ranked)}, 2)
    for s in sizes:
        mine = [r for r in rows if of[r["doc_id"]] == s]
        assert all(abs(r["target"] - want[s]) < 1e-6 and r["source_size"] == sizes[s] and r["taken"] <= 2 * r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= 1
    used = uses.groupBy("doc_id").agg(F.sum(F.col("upto") - F.col("first")).alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in used} == {r["doc_id"]: r["taken"] for r in rows if r["taken"]}
    mixed = mixing.mixed_documents(docs, block=16, shard_slots=64, slack=0.0)
    assert mixed.columns == docs.columns
    assert mixed.select(F.sum(mixing.word_count(F.col("text")))).first()[0] == sum(r["taken"] for r in rows)


def test_draws_decide_shards_and_totals_within_the_slack(spark):
    rng = random.Random(8)
    sources = [rng.choice("aabbc") for _ in range(300)]
    docs = table(spark, [words(rng, rng.randint(40, 160)) for _ in sources], sources=sources)
    documents, uses = mixing.mix(docs, block=8, shard_slots=128, slack=0.05)
    rows, used = documents.collect(), uses.collect()
    of, strays = dict(enumerate(sources)), []
    for s in "abc":
        mine = [r for r in rows if of[r["doc_id"]] == s]
        strays.append(sum(r["taken"] for r in mine) - mine[0]["target"])
        assert abs(strays[-1]) <= 0.05 * mine[0]["target"] + 8 and all(r["taken"] <= 2 * r["size"] for r in mine)
    assert any(abs(x) > 8 for x in strays)
    for r in rows:
        assert r["shards"] == sorted({u["shard"] for u in used if u["doc_id"] == r["doc_id"]})
    words_of = {}
    for u in used:
        words_of[u["shard"], u["source"]] = words_of.get((u["shard"], u["source"]), 0) + u["upto"] - u["first"]
    shares = [words_of.get((k, "a"), 0) / sum(words_of.get((k, s), 0) for s in "abc") for k in sorted({k for k, _ in words_of})[:-1]]
    assert len(set(shares)) > 3 and max(shares) - min(shares) < 0.4


def test_mix_tells_rows_of_one_identifier_apart(spark):
    texts = [f"{c}{i} " * 40 for i in range(6) for c in "abc"]
    rows = [([7, None, i][i % 3], x, "en", ["s", None][i % 2], len(x)) for i, x in enumerate(texts)] + [(7, "same words " * 20, "en", "s", 220)] * 3
    docs = spark.createDataFrame(rows, DOCS)
    documents, _ = mixing.mix(docs, block=16, shard_slots=64)
    taken, sizes = documents.agg(F.sum("taken")).first()[0], {x: len(x.split()) for _, x, *_ in rows}
    mixed = mixing.mixed_documents(docs, block=16, shard_slots=64).collect()
    used = {}
    for r in mixed:
        words = r["text"].split()
        (whole,) = {x for _, x, *_ in rows if words[0] in x.split()}
        assert set(words) <= set(whole.split())
        used[whole] = used.get(whole, 0) + len(words)
    assert sum(used.values()) == taken
    assert all(n <= 2 * sizes[x] * sum(x == y for _, y, *_ in rows) for x, n in used.items())


def test_mix_odd_rows(spark, odd):
    clash = odd
    for name in ("_id", "_n", "_size", "_words", "_ranges", "_row", "_text", "_nth", "src", "start", "takes"):
        clash = clash.withColumn(name, F.lit("x"))
    assert mixing.mixed_documents(clash).columns == clash.columns and {r["_size"] for r in mixing.mixed_documents(clash).collect()} == {"x"}
    assert mixing.mixed_documents(odd.limit(0)).count() == 0
    documents, _ = mixing.mix(odd)
    assert documents.count() == odd.count() and mixing.mix(odd.limit(0))[0].count() == 0
    assert mixing.mix(odd.where("doc_id < 3"))[0].agg(F.sum("taken")).first()[0] == 0


@pytest.mark.parametrize("n", [1, 2, 101, 20_000])
def test_permutation_is_one_and_moves_blocks_anywhere(spark, n):
    at = spark.range(n).select(mixing.position(F.col("id"), F.lit(n).cast("long"), F.lit(3).cast("long"), F.lit(1).cast("long")).alias("p"))
    p = np.array([r["p"] for r in at.collect()])
    assert sorted(p) == list(range(n))
    if n > 10_000:  # as of a shuffle: few stay, a third of the way on average, neighbours part
        assert (p == np.arange(n)).sum() <= 6 and abs(np.abs(p - np.arange(n)).mean() / n - 1 / 3) < 0.01
        assert abs(np.corrcoef(p[:-1], p[1:])[0, 1]) < 0.03 and (np.abs(np.diff(p)) <= 2).sum() <= 20


def test_blocks_beyond_32_bits_land_everywhere(spark):
    n = 5 << 33
    blocks = spark.range(0, n, n // 4000).select(mixing.position(F.col("id"), F.lit(n).cast("long"), F.lit(3).cast("long"), F.lit(0).cast("long")).alias("p"))
    p = np.array([r["p"] for r in blocks.collect()])
    assert len(set(p)) == len(p) and p.min() >= 0 and p.max() < n
    tenths = np.bincount(p * 10 // n, minlength=10) / len(p)
    assert tenths.min() > 0.08 and tenths.max() < 0.12
    slots = spark.range(0, n, n // 4000).select(mixing.drawn_at(F.col("id"), n, 7).alias("v"))
    v = np.array([r["v"] for r in slots.collect()])
    tenths = np.bincount(v * 10 // n, minlength=10) / len(v)
    assert v.min() >= 0 and v.max() < n and tenths.min() > 0.08 and tenths.max() < 0.12 and len(set(v % 1024)) > 900


def test_many_sources_are_ranked_over_ranges(spark, monkeypatch):
    rng = random.Random(9)
    sources = [rng.choice([None, *(f"s{k}" for k in range(60))]) for _ in range(500)]
    docs = table(spark, [words(rng, rng.randint(0, 90)) for _ in sources], sources=sources)
    key = lambda df: sorted(map(repr, df.collect()))
    one = [key(df) for df in mixing.mix(docs, block=16, shard_slots=64)]
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    documents, uses = mixing.mix(docs, block=16, shard_slots=64)
    assert [key(documents), key(uses)] == one


# -- language ID --------------------------------------------------------------------------------


def test_language_id(spark, odd):
    rng = random.Random(8)
    syllables = {"en": ["the", "ing", "er", "th"], "fr": ["eau", "é", "ou", "que"], "de": ["sch", "ü", "ung", "ei"]}
    langs = [rng.choice(list(syllables)) for _ in range(240)]
    texts = [" ".join("".join(rng.choices(syllables[x], k=3)) for _ in range(30)) for x in langs]
    docs = table(spark, [*texts, None, "12 34", LONG], [*langs, "en", "en", None])
    rows = langid.identify(docs).collect()
    assert len(rows) == 243
    got = {r["doc_id"]: r for r in rows}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(243))
    tested = [i for i in range(240) if got[i]["held_out"]]
    assert np.mean([got[i]["lang_pred"] == langs[i] for i in tested]) > 0.95
    assert (got[240]["lang_pred"], got[241]["lang_pred"], got[240]["score"]) == ("und", "und", 0.0)
    assert all(0 <= r["score"] <= 1 for r in rows)
    kept = langid.accepted_documents(docs)
    assert kept.columns == docs.columns and kept.count() == 241
    assert langid.identify(odd).count() == odd.count() and langid.identify(odd.limit(0)).count() == 0


def test_pipeline_hands_on_the_language_found(spark):
    stages = dict(pytest.importorskip("corpus_pipeline").STAGES)
    rng = random.Random(8)
    syllables = {"en": ["the", "ing", "er", "th"], "fr": ["eau", "é", "ou", "que"], "de": ["sch", "ü", "ung", "ei"]}
    made = lambda lang, n=30: " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(n))
    langs = [rng.choice(list(syllables)) for _ in range(240)]
    texts = [*[made(x) for x in langs], made("fr", 3000), made("de"), made("fr", 6), made("en"), None, "12 34"]
    docs = table(spark, texts, [*langs, None, None, "en", "de", "en", "en"])
    told = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs).collect()}
    assert [told[i] for i in range(240, 246)] == ["fr", "de", "fr", "en", "und", "und"]
    after = common.written(stages["language_id"](spark, docs, ""), "t")
    got = {r["doc_id"]: r.asDict() for r in after.collect()}
    assert after.schema == docs.schema and {i: r["lang"] for i, r in got.items()} == {i: x for i, x in told.items() if x != "und"}
    given = {r["doc_id"]: r.asDict() for r in docs.collect()}
    assert all(r | {"lang": None} == given[i] | {"lang": None} for i, r in got.items())
    packed = stages["packing"](spark, after, "").collect()
    assert {(r["doc_id"], r["lang"]) for r in packed} == {(i, r["lang"]) for i, r in got.items()} and len(packed) > len(got)
    same = lambda rows: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["sequence_id"], r["offset"]) for r in rows)
    assert same(packed) == same(packing.pack(after).collect())


# -- HTML ---------------------------------------------------------------------------------------


def page(n, body):
    return f'<html><head><title>T{n}</title><style>p{{}}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></ul></nav><div class="ad">Buy {n}</div><div class="c">{body}</div><div>All rights kept</div><footer>f</footer></body></html>'


def test_wrapper_finds_content(spark):
    rows = [(i, "http://h.example/x", page(i, f"<h1>Head {i}</h1><p>Body <b>{i}</b> &amp; more<br>lines<p>Second {i}<div class='comments'>no</div>")) for i in range(8)]
    rows += [(100, None, None), (101, "", ""), (102, "http://o.example", "just text"), (103, "x", "<p>one<p>two <!-- c --><aside>no</aside>"), (104, "http://h.example/x", "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r for r in wrapper.main_text(pages).collect()}
    for i in range(8):
        assert got[i]["text"] == f"Head {i}\n\nBody {i} & more lines\n\nSecond {i}" and got[i]["n_chars"] == len(got[i]["text"])
    assert (got[100]["text"], got[101]["text"], got[102]["text"], got[103]["text"], got[104]["text"]) == ("", "", "just text", "one\n\ntwo", "deep")
    assert wrapper.main_text(pages.limit(0)).count() == 0


def texts_of(spark, sites):
    """The texts of the pages of several sites, a host each."""
    rows = [(1000 * h + k, f"http://h{h}.example/{k}", html) for h, pages in enumerate(sites) for k, html in enumerate(pages)]
    got = {r["page_id"]: r["text"] for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    return [[got[1000 * h + k] for k in range(len(pages))] for h, pages in enumerate(sites)]


def test_wrapper_keeps_what_lies_beside_the_longest_block(spark):
    sites, want = [], []
    for box in ("<div class='body'>{}</div>", "<ul><li>{}</ul>", "<section>{}</section>"):
        for around in ("<article>{}</article>", "<div class=post>{}</div>"):
            sites.append(["<div class=top>Site</div>" + around.format(f"<h1>Title {i}</h1><p>lead {i}</p>" + box.format(f"long {i} " * 90) + f"<p>note {i}</p>") for i in range(6)])
            want.append(["\n\n".join([f"Title {i}", f"lead {i}", " ".join([f"long {i}"] * 90), f"note {i}"]) for i in range(6)])
    sites.append([f"<div class=a><div class=b>{'long ' * 60}{i}</div></div>" for i in range(9)] + ["<div class=a><div class=b>date</div></div><div class=other>The minority's body</div>"])
    want.append([f"{'long ' * 60}{i}" for i in range(9)] + ["date\n\nThe minority's body"])
    sites.append(["<div class=card><p>Same</p></div>" * 5 + f"<div class=x>{i}</div>" for i in range(2)])
    want.append(["\n\n".join(["Same"] * 5 + [str(i)]) for i in range(2)])
    assert texts_of(spark, sites) == want


def test_wrapper_does_not_take_names_for_more_than_they_say(spark):
    sites, want = [], []
    for attrs in ("style='overflow:hidden'", "title='The hidden valley'", "data-x=hidden", "title='display:none'"):
        sites.append([f"<div {attrs}><p>body</p></div>"])
        want.append(["body"])
    for attrs in ("hidden", "class=x hidden=''", "style='color:red; Display : none'", 'STYLE="display:none"'):
        sites.append([f"<div {attrs}>gone</div><p>body</p>"])
        want.append(["body"])
    for tag in ("div class='content with-sidebar'", "div class='post-share-enabled'", "div class='widget'", "span class='overlay'"):
        sites.append([f"<p>{i}</p><{tag}><p>Text {i} {'more ' * 20}</p><div class='share'>Share {i}</div></{tag.split()[0]}>" for i in range(5)])
        want.append([f"{i}\n\nText {i} {' '.join(['more'] * 20)}" for i in range(5)])
    sites.append([f"<div class=ad>{'Buy this ' * 20}{i}</div><article><p>a{i}</p><div class='comments'>no {i}</div></article>" for i in range(5)])
    want.append([f"a{i}" for i in range(5)])
    sites.append(["<div class=ad>Buy</div><div class='content with-sidebar'>body</div>"])
    want.append(["body"])
    assert texts_of(spark, sites) == want


# -- WARC ---------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    big = "x" * 2000
    rows = [(1, "http://a", big), (2, None, big), (3, "http://b\nc", "small"), (4, "u", "small"), (5, "u", None), (6, "u", "é" * 600), (7, "u", "y" * 3_000_000), (2, None, big), (None, "u", "lone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = sorted((r["page_id"] or -1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect())
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        keeper = max((j or -1) for j, _, h in rows if (h or "") == (html or ""))
        again = len(data) >= 1000 and i != keeper
        want.append((i or -1, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", keeper if again else None))
    assert got == sorted(want, key=lambda w: (w[0], w[1]))
    assert warc.round_trip(pages.limit(0)).count() == 0
    folder = f"file://{tmp_path}"
    warc.write_archives(pages.coalesce(1), folder)
    (path,) = tmp_path.glob("*.warc.zst")
    assert {r["payload"].decode() for r in warc.read_archives(spark, folder).where("record_type = 'response'").collect()} == {h or "" for _, _, h in rows}
    data = path.read_bytes()
    for broken in (data[:-3], data[:40], data + b"junk", data[: len(data) // 2] + b"\0" + data[len(data) // 2 + 1 :]):
        path.write_bytes(broken)
        with open(path, "rb") as f, pytest.raises(warc.ArchiveError):
            list(warc.read_archive(f, "t"))


# -- PII ----------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            bad = (kind == "ip" and any(int(p) > 255 for p in m.group().split("."))) or (kind == "card" and not (12 <= len(digits) <= 19 and pii.luhn(digits))) or (kind == "phone" and not 9 <= len(digits) <= 15)
            if not bad:
                out.append((m.start(), m.end(), kind))
    return out


def test_pii_base_matches_brute_force(spark, odd):
    rng = random.Random(9)
    texts = ["".join(rng.choice("aZ1.@-+ ()%9é_") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["4111 1111 1111 1111 x", "call +1 (555) 123-4567 now", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "x" * 5000 + "@y.z"]
    for t in texts:
        assert sorted(pii.plain_spans(t)) == sorted(brute_spans(t)), t
    rows = pii.find_personal_data(table(spark, texts)).orderBy("doc_id").collect()
    order = list(PATTERNS)
    for t, r in zip(texts, rows, strict=True):
        spans = sorted(brute_spans(t), key=lambda s: (s[0], order.index(s[2])))
        listed = ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest() and r["n_email"] == sum(s[2] == "email" for s in spans)
        assert set(filter(None, listed.split(","))) <= set(r["spans"].split(","))
    assert pii.find_personal_data(odd).count() == odd.count() and pii.find_personal_data(odd.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("mail john.doe [at] example (dot) com now", ("john.doe [at] example (dot) com", "email")),
        ("write to jane at mail dot example dot com.", ("jane at mail dot example dot com", "email")),
        ("😀 jоhn@exаmple.cоm", ("jоhn@exаmple.cоm", "email")),
        ("call plus one two zero two five five five zero one two three ok", ("plus one two zero two five five five zero one two three", "phone")),
        ("ip 10[.]20[.]30[.]40 x", ("10[.]20[.]30[.]40", "ip")),
        ("４１１１ １１１１ １１１１ １１１１", ("４１１１ １１１１ １１１１ １１１１", "card")),
    ],
)
def test_disguises_map_back(text, found):
    base, extra = pii.detect(text)
    assert base == [] and [(text[a:b], k) for a, b, k in extra] == [found]


@pytest.mark.parametrize("address", ["john@example dot com", "john at example.com", "john at firm dot pl", "john at firm dot app", "john [at] example dot com", "john at example [dot] com", "john@firm dot intern", "j.doe @ mail.firm dot de", "john dot doe at firm dot co dot uk", "JOHN AT FIRM DOT COM", "john@firm . nl"])
def test_each_sign_may_be_disguised_alone(address):
    for text in (address, f"Write to {address}. Then wait", f"({address}, or not)"):
        base, extra = pii.detect(text)
        assert base == [] and [(text[a:b], k) for a, b, k in extra] == [(address, "email")]


def test_plain_addresses_stay_as_they_are():
    for text in ("john@example.com . Then", "john@example.com dot product", "we sat at home.Then", "at 3.5 or at 10.20.30", "lunch @ noon . Bring it"):
        assert pii.detect(text)[1] == []


@pytest.mark.parametrize("text", ["look at that dot then", "one two three four went home", "meet me at five (at most six)", "русский текст без данных", "we sat at home. Dot was there"])
def test_clean_texts_have_no_spans(text):
    assert pii.detect(text) == ([], [])


SPOKEN = "zero one two three four five six seven eight nine".split()
GLYPHS = dict(zip("aeopcxyABEKMHOPCTX", "аеорсхуАВЕКМНОРСТХ", strict=True))


def test_long_digit_runs_and_foreign_texts():
    assert pii.detect("0" * 10_000 + "7.1.1.1 " + "9" * 10_000 + ".1.1.1") == ([(0, 10_007, "ip")], [])
    assert [s[2] for s in pii.detect("john-AT-example.com, jo_At_ex_Dot_org")[1]] == ["email", "email"]
    foreign = ("Это обычный русский текст о погоде и природе, т.е. без данных – совсем. " * 30_000)[:2_000_000]
    assert list(pii.folded_tokens(foreign)) == [] and pii.detect(foreign) == ([], [])
    assert [s[2] for s in pii.detect("почта jоhn@exаmple.com здесь")[1]] == ["email"] and [s[2] for s in pii.detect("тел. ＋４９ １７０ １２３４５６７")[1]] == ["phone"]


def disguised(rng, kind):
    """(disguised identifier, kind) by one of the ways that people use."""
    digits = lambda n: "".join(str(rng.randrange(10)) for _ in range(n))
    if kind == "email":
        user, host, top = rng.choice(["jane", "john.doe", "k.li77", "max_m"]), rng.choice(["example", "mail-box", "firm24"]), rng.choice(["com", "org", "de", "museum", "app", "co.uk"])
        plain = f"{user}@{host}.{top}"
        spoken = lambda at, dot: plain.replace(".", dot).replace("@", at)
        ways = [spoken(" at ", " dot "), spoken(" [at] ", " [dot] "), spoken("(at)", "."), spoken("@", " dot "), spoken(" AT ", " DOT "), spoken("{at}", "{dot}"), spoken(" at ", ".")]
        if "-" not in plain and "_" not in plain:
            ways.append(spoken("_at_", "_dot_"))
        ways += ["".join(GLYPHS.get(c, c) for c in plain), "".join(chr(ord(c) + 0xFEE0) if "!" < c < "~" else c for c in plain), plain.replace("e", "\u200be").replace("a", "\u200ba")]
        ways += ["".join(chr(0x1D5EE + ord(c) - 97) if "a" <= c <= "z" else c for c in plain), "".join({"a": "ᴀ", "e": "ᴇ", "o": "ᴏ", "m": "ᴍ"}.get(c, c) for c in plain)]
    elif kind == "ip":
        parts = [str(rng.randrange(10, 256)) for _ in range(4)]
        ways = ["[.]".join(parts), " dot ".join(parts), "(dot)".join(parts), " dot ".join(" ".join(SPOKEN[int(d)] for d in p) for p in parts), ".".join(parts).replace("1", "l", 1) if "1" in "".join(parts) else "[dot]".join(parts)]
    elif kind == "card":
        body = "4" + digits(14)
        plain = body + next(str(c) for c in range(10) if pii.luhn(body + str(c)))
        ways = [" ".join(SPOKEN[int(d)] for d in plain), "".join(chr(0xFF10 + int(d)) for d in plain), "".join(chr(0x1D7CE + int(d)) for d in plain), " ".join(f"[{SPOKEN[int(d)]}]" for d in plain), plain[0] + plain[1:].replace("0", "O").replace("1", "I") if set(plain[1:]) & set("01") else "-".join(SPOKEN[int(d)] for d in plain)]
    else:
        plain = digits(11)
        ways = ["plus " + " ".join(SPOKEN[int(d)] for d in plain), "+" + "".join(chr(0xFF10 + int(d)) for d in plain), "＋" + plain, "+" + "\u2013".join([plain[:2], plain[2:6], plain[6:]])]
    return rng.choice(ways), kind


def test_disguises_are_found_again():
    rng = random.Random(31)
    missed, total = {}, 0
    for k in range(1200):
        text, kind = disguised(rng, pii.KINDS[k % 4])
        said = f"Please note {text} as it stands here"
        base, extra = pii.detect(said)
        at = said.index(text)
        total += 1
        if not any(c == kind and at <= a and b <= at + len(text) and b - a >= 0.8 * len(text) for a, b, c in [*base, *extra]):
            missed.setdefault(kind, []).append(text)
    assert sum(map(len, missed.values())) <= 0.1 * total, {k: (len(v), v[:4]) for k, v in missed.items()}


def test_clean_prose_has_few_spans():
    rng = random.Random(32)
    common = "the at dot point a one two three we look that then home noon is of on Oslo Bill solo I will 3 10 2024 in 5 or more than 1.5 (about) least at 4 o'clock point 2 Sibb oil lol 100 per cent".split()
    spans = sum(len(pii.detect(" ".join(rng.choice(common) for _ in range(60)) + ".")[1]) for _ in range(1500))
    assert spans <= 45, spans


# -- embeddings ---------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [512, 5])
def test_cross_polytope_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(crosspoly, "BLOCK", block)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    vectors = [*base, *(base[:20] * 3), *(base[:10] + rng.normal(size=(10, 16)) * 0.05), *(base[0] + rng.normal(size=(25, 16)) * 0.03), *base[:5]]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None]), (904, []), (905, [1.0, 0.0]), (906, [1e-300, 0.0]), (907, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("digest", F.lit("clash"))
    got = {r["vec_id"]: r for r in crosspoly.near_duplicates(df).collect()}
    ok = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if i < 900}
    ok |= {905: np.array([1.0, 0.0]), 906: np.array([1.0, 0.0])}
    links = [(a, b) for a, b in itertools.combinations(ok, 2) if len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= 0.95]
    label = {i: i for i, _ in rows}
    for _ in range(len(rows)):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert len(got) == len(rows)
    for i in label:
        assert got[i]["n_links"] == sum(i in p for p in links), i
        assert got[i]["component_id"] == label[i] and got[i]["kept"] == (label[i] == i)
    assert crosspoly.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("dim", [64, 256, 768])
@pytest.mark.parametrize("functions", [3, 4, 5, 6])
def test_recall_holds_as_functions_and_dimensions_grow(functions, dim):
    rng = np.random.default_rng(functions * dim)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    x = unit(rng.normal(size=(240, dim)))
    away = rng.normal(size=x.shape)
    away = unit(away - (away * x).sum(axis=1, keepdims=True) * x)
    tables = crosspoly.tables_for(functions)
    a, b = (crosspoly.bucket_keys(v, functions, tables) for v in (x, 0.95 * x + np.sqrt(1 - 0.95**2) * away))
    assert np.mean([bool(set(p) & set(q)) for p, q in zip(a.tolist(), b.tolist(), strict=True)]) >= 0.95


def test_hash_recall_at_threshold():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n = rng.normal(size=x.shape)
    n -= (n * x).sum(1, keepdims=True) * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * n / np.linalg.norm(n, axis=1, keepdims=True)
    a, b = crosspoly.bucket_keys(x, 3), crosspoly.bucket_keys(y, 3)
    assert np.mean([(a[:, i : i + 1] == b).any(1) for i in range(a.shape[1])], axis=0).astype(bool).mean() > 0.99
    one, two = crosspoly.sketches(x).view(np.uint64), crosspoly.sketches(y).view(np.uint64)
    assert np.bitwise_count(one ^ two).astype(int).sum(1).max() <= crosspoly.most_apart(0.95) < np.bitwise_count(one ^ one[::-1]).astype(int).sum(1).mean() - 20


def test_rows_of_one_vec_id_are_a_vector_each(spark):
    rows = [(1, [1.0, 0.0, 0.1]), (1, [1.0, 0.0, 0.1]), (1, [0.0, 1.0, 0.0]), (2, [0.0, 1.0, 0.02]), (None, [0.0, 0.0, 1.0])]
    got = sorted(((r["vec_id"] or -1, r["n_links"]) for r in crosspoly.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    assert got == [(-1, 0), (1, 1), (1, 1), (1, 1), (2, 1)]
    assert {r["component_id"] for r in crosspoly.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()} == {1, None}


# -- prefix sums, pipeline ----------------------------------------------------------------------


def test_running_total(spark):
    rows = [(k, i % 5, i, i * 3 % 7) for k in (1, 2) for i in range(50)]
    df = spark.createDataFrame(rows, "k int, c int, i int, v long")
    got = {(r["k"], r["i"]): r["out"] for r in common.running_total(df, ["k"], "c", ["i"], "v", "out").collect()}
    for k in (1, 2):
        total = 0
        for _, _, i, v in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            assert got[k, i] == total
            total += v


def test_pipeline_stages(spark, odd):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(11)
    clean = [words(rng, rng.randint(20, 80), 100_000) for _ in range(60)]
    texts = [*clean, clean[0].upper(), clean[1] + " extra", "123 456", None]
    docs = table(spark, texts, sources=[f"s{i % 3}" for i in range(len(texts))])
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    after = common.written(stages["language_id"](spark, docs, ""), "t")
    assert {r["doc_id"] for r in after.collect()} == set(range(62)) and after.columns == docs.columns
    after = common.written(stages["exact_dedup"](spark, after, ""), "t")
    assert {r["doc_id"] for r in after.collect()} == set(range(62)) - {0} and after.columns == docs.columns
    after = common.written(stages["ngram_jaccard_join"](spark, after, ""), "t")
    assert {r["doc_id"] for r in after.collect()} == set(range(1, 61)) and after.columns == docs.columns
    mixed = common.written(stages["source_mix"](spark, after, ""), "t")
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= set(range(1, 61))
    packed = stages["packing"](spark, mixed, "")
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in mixed.collect()}
    assert packed.agg(F.sum("length")).first()[0] == packed.select("doc_id", "doc_tokens", "start").where("start = 0").agg(F.sum("doc_tokens")).first()[0]


@pytest.mark.parametrize("stage", ["language_id", "exact_dedup", "ngram_jaccard_join", "source_mix", "packing"])
def test_pipeline_stages_take_odd_rows(spark, odd, stage):
    run = dict(pytest.importorskip("corpus_pipeline").STAGES)[stage]
    clash = odd
    for name in ("_id", "_digest", "_row", "_n", "_h1", "_h2", "_number", "_kept", "_size", "_words", "_salt", "shard", "sig", "p", "h", "tokens"):
        clash = clash.withColumn(name, F.lit("x"))
    rows = run(spark, clash, "").collect()
    ids = sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in rows)
    if stage == "packing":
        assert set(ids) == {-1, 1, 2, 3, 4, 5, 6, 8}
    else:
        assert rows[0].asDict().keys() == dict.fromkeys(clash.columns).keys() and all(r["_row"] == "x" and r["sig"] == "x" for r in rows)
    if stage == "language_id":
        assert ids == [-1, 4, 5, 6, 6]
    elif stage == "exact_dedup":
        assert ids == [-1, 2, 3, 4, 6, 8]
    elif stage == "ngram_jaccard_join":
        assert ids == [-1, 1, 2, 3, 4, 5, 8]
    elif stage == "source_mix":
        assert set(ids) <= {-1, 4, 5, 6, 8} and 4 in ids
    assert run(spark, clash.limit(0), "").count() == 0
