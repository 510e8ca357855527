"""Spelling variants: words one edit apart, found through a dictionary of trie-node pairs.

The vocabulary is laid out in sorted order twice, as it is and reversed, and the nodes of both tries
are numbered. A word is then a row of integer pairs: the node of what precedes a position and the
node of what follows it, with the position's letter skipped or with nothing between. Words that
differ by a replaced letter share a pair with a skip in both; words that differ by an inserted or
deleted letter share a pair with a skip in the longer one. Pairs are equal only if both strings are,
so the join gives exactly the neighbours. A pair has no more words than letters plus one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemo.llm.common import UPPER, sliced, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans(UPPER, UPPER.lower())
SHORTEST, SEEN, OFTEN, DROPPED = 6, 5, 5, 199
HELD_WORDS = 300_000
PIECE = 1 << 20


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in parts of about ``size`` characters that cut no run of letters."""
    at = 0
    while len(text) - at > size:
        end = at + size
        run = RUN.match(text, end)
        end = run.end() if run else end
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def runs_of(text: str) -> Counter:
    found: Counter = Counter()
    for part in pieces(text):
        found.update(RUN.findall(part))
    return found


def with_slips(doc_id: int | None, low: str) -> str:
    """The word, or what is left of it where the checksum of document and word says that a letter is missing."""
    h = zlib.crc32(low.encode(), zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id))
    if h % DROPPED:
        return low
    at = h % len(low)
    return low[:at] + low[at + 1 :]


def counted(batches: Iterator[pa.RecordBatch], shortest: int = SHORTEST) -> Iterator[pa.RecordBatch]:
    """(word, n): words of a task's documents, counted as far as some hundred thousand can be held."""
    held: dict[str, int] = {}

    def out() -> Iterator[pa.RecordBatch]:
        words, n = list(held), list(held.values())
        held.clear()
        for a in range(0, len(words), 20_000):
            yield pa.RecordBatch.from_pydict({"word": pa.array(words[a : a + 20_000], pa.string()), "n": pa.array(n[a : a + 20_000], pa.int64())})

    for batch in sliced(batches):
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            lows: dict[str, int] = {}
            for run, n in runs_of(text.as_py() or "").items():
                if len(run) >= shortest:
                    low = run.lower() if run.isascii() else run.translate(LOWER)
                    lows[low] = lows.get(low, 0) + n
            for low, n in lows.items():
                word = with_slips(doc_id, low)
                if len(word) >= shortest:
                    held[word] = held.get(word, 0) + n
            if len(held) >= HELD_WORDS:
                yield from out()
    yield from out()


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, seen: int = SEEN) -> DataFrame:
    """(word, n) of all words of at least so many letters that occur at least so often in all texts."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda batches: counted(batches, shortest), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= seen)


NODES = pa.schema([("word", pa.string()), ("n", pa.int64()), ("part", pa.int32()), ("local", pa.int64()), ("nodes", pa.list_(pa.int64()))])


def nodes_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trie nodes of sorted keys, numbered from 1 in order of their first key. Columns: word, n, key.

    The stack holds the nodes of the last key; a key shares with it those of their common prefix.
    """
    part = TaskContext.get().partitionId()
    last, stack, free, local = "", [], 1, 0
    for batch in sliced(batches, 10_000):
        nodes = []
        for key in batch.column(2).to_pylist():
            same, most = 0, min(len(last), len(key))
            while same < most and last[same] == key[same]:
                same += 1
            stack = stack[:same] + list(range(free, free + len(key) - same))
            free += len(key) - same
            last = key
            nodes.append(stack)
        rows = batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([part] * rows, pa.int32()), pa.array(range(local, local + rows), pa.int64()), pa.array(nodes, pa.list_(pa.int64()))], schema=NODES)
        local += rows


def common(a: str, b: str) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def stitched(parts: list[dict]) -> list[dict]:
    """For each range of keys where its numbers start and the nodes that its first key shares with earlier ranges.

    ``parts``: first and last key, the last key's nodes, nodes and words of each range, in order.
    """
    out: list[dict] = []
    number = word = 0
    before, path = "", []
    for p in parts:
        shared = path[: common(before, p["first"])]
        out.append({"part": p["part"], "number": number, "rank": word, "shared": shared})
        path = [shared[x - 1] if x <= len(shared) else number + x for x in p["nodes"]]
        before, number, word = p["last"], number + p["most"], word + p["rows"]
    return out


STARTS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("number", T.LongType()), T.StructField("rank", T.LongType()), T.StructField("shared", T.ArrayType(T.LongType()))])


def numbered(words: DataFrame, key: Column, name: str) -> DataFrame:
    """(word, n, rank, nodes): places in the order of ``key``, and the trie nodes of its prefixes, root (0) first.

    Each range of keys is numbered by itself. What reaches the driver is one row a range: its first
    and last key and counts; from these come the ranges' offsets and the nodes they share.
    """
    laid = words.select("word", "n", key.alias("key")).repartitionByRange("key").sortWithinPartitions("key")
    rows = written(laid.mapInArrow(nodes_in, "word string, n long, part int, local long, nodes array<long>"), name)
    ends = rows.groupBy("part").agg(F.min_by("word", "local").alias("first"), F.max_by("word", "local").alias("last"), F.max_by("nodes", "local").alias("nodes"), F.max(F.array_max("nodes")).alias("most"), F.count(F.lit(1)).alias("rows"))
    ends = ends.select("part", "nodes", "most", "rows", *(F.reverse(c).alias(c) if name.endswith("reversed") else c for c in ("first", "last")))
    starts = stitched([r.asDict() for r in ends.orderBy("part").collect()])
    at = words.sparkSession.createDataFrame([tuple(s[c] for c in STARTS.names) for s in starts], STARTS)
    number = lambda x: F.when(x <= F.size("shared"), F.get("shared", (x - 1).cast("int"))).otherwise(F.col("number") + x)
    return rows.join(F.broadcast(at), "part").select("word", "n", (F.col("rank") + F.col("local")).alias("rank"), F.concat(F.array(F.lit(0).cast("long")), F.transform("nodes", number)).alias("nodes"))


def pair_dictionary(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(numbered words, entries): entries (p, s, kind, id, n), kind 0 nothing skipped, 1 a letter skipped, 2 the first of equal letters."""
    ahead = numbered(words, F.col("word"), "spelling-forward").withColumnRenamed("nodes", "pre")
    back = numbered(words, F.reverse("word"), "spelling-reversed").select("word", F.reverse("nodes").alias("suf"))
    nodes = ahead.join(back, "word")
    size = F.char_length("word")
    letter = lambda i: F.substring("word", i, 1)  # noqa: E731  counted from 1
    entry = lambda p, s, kind: F.struct(F.get("pre", p).alias("p"), F.get("suf", s).alias("s"), kind.cast("byte").alias("kind"))
    whole = F.transform(F.sequence(F.lit(0), size), lambda i: entry(i, i, F.lit(0)))
    skip = F.transform(F.sequence(F.lit(0), size - 1), lambda i: entry(i, i + 1, F.when((i > 0) & (letter(i + 1) == letter(i)), 1).otherwise(2)))
    return ahead.select(F.col("rank").alias("id"), "word", "n"), nodes.select(F.col("rank").alias("id"), "n", F.inline(F.concat(whole, skip)))


def neighbours(entries: DataFrame) -> DataFrame:
    """(id, n_near, best): how many words are one edit away, and the one of largest n, then smallest id.

    A replaced letter is met at its own position only; an inserted one at the first of a run of equal
    letters only: so every two neighbours meet once. Counts and best of a pair's words come from its
    sorted list, which has one word without a skip and at most one for each letter with it.
    """
    several = entries.withColumn("_c", F.count(F.lit(1)).over(Window.partitionBy("p", "s"))).where("_c > 1")
    item = F.struct("n", (-F.col("id")).alias("back"), "kind")
    lists = several.groupBy("p", "s").agg(F.sort_array(F.collect_list(item), asc=False).alias("all"))
    of = lambda test: F.filter("all", lambda x: test(x["kind"]))
    lists = lists.select("all", of(lambda k: k == 0).alias("whole"), of(lambda k: k > 0).alias("skipped"), of(lambda k: k == 2).alias("firsts"))
    plain = lambda x: F.when(x.isNotNull(), F.struct(x["n"].alias("n"), x["back"].alias("back")))
    x = F.col("x")
    other = F.when(F.get("skipped", F.lit(0))["back"] == x["back"], F.get("skipped", F.lit(1))).otherwise(F.get("skipped", F.lit(0)))
    longer, shorter = F.get("firsts", F.lit(0)), F.get("whole", F.lit(0))
    rows = lists.select(F.explode("all").alias("x"), "whole", "skipped", "firsts").select(
        (-x["back"]).alias("id"),
        F.when(x["kind"] == 0, F.size("firsts")).otherwise(F.size("skipped") - 1 + F.when(x["kind"] == 2, F.size("whole")).otherwise(0)).alias("near"),
        F.when(x["kind"] == 0, plain(longer)).when(x["kind"] == 1, plain(other)).otherwise(F.greatest(plain(other), plain(shorter))).alias("best"),
    )
    return rows.where("near > 0").groupBy("id").agg(F.sum("near").cast("long").alias("n_near"), F.max("best").alias("best"))


def followed(forms: DataFrame) -> DataFrame:
    """(id, to) with every link followed to its end, by doubling: chains are short, as n grows five times a step."""
    links = written(forms, "spelling-links")
    while True:
        ahead = links.select(F.col("id").alias("to"), F.col("to").alias("_next"))
        links = written(links.join(ahead, "to", "left").select("id", F.coalesce("_next", "to").alias("to"), F.col("_next").isNotNull().alias("moved")), "spelling-links")
        moved, links = links.where("moved"), links.drop("moved")
        if moved.isEmpty():
            return links


def variants(docs: DataFrame, shortest: int = SHORTEST, seen: int = SEEN, often: int = OFTEN) -> DataFrame:
    """One row per word: its occurrences, its neighbours, its form and the form that forms lead to.

    Null text has no words; a null doc_id counts as nothing before the colon of the checksum; rows that
    repeat are counted each; an empty table gives an empty result; other columns are ignored. A word's
    form is its neighbour of largest n, of equal ones the first in code-point order, if that is at
    least ``often`` times the word's n.
    """
    words = written(vocabulary(docs, shortest, seen), "spelling-words")
    named, entries = pair_dictionary(words)
    named = written(named, "spelling-named")
    near = written(neighbours(entries), "spelling-near")
    rows = named.join(near, "id", "left").withColumn("form_id", F.when(F.col("best.n") >= F.lit(often) * F.col("n"), -F.col("best.back")))
    rows = written(rows.select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_id"), "spelling-rows")
    linked = rows.where("form_id IS NOT NULL")
    ends = followed(linked.select("id", F.col("form_id").alias("to"))).select("id", F.col("to").alias("root_id"))
    names = named.select(F.col("id").alias("form_id"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    tops = named.select(F.col("id").alias("root_id"), F.col("word").alias("root"))
    found = linked.join(names, "form_id").join(ends, "id").join(tops, "root_id").select("word", "n", "form", "root", "n_near", "form_n")
    alone = rows.where("form_id IS NULL").select("word", "n", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n_near", F.lit(None).cast("long").alias("form_n"))
    return found.unionByName(alone)


SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))) ORDER BY b) AS bytes FROM range(256) r(b)),
runs AS (
  SELECT doc_id, translate(run, '{UPPER}', '{UPPER.lower()}') AS low, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
marked AS (
  SELECT low, n, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || low, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END))),
    lambda c, b: xor(c >> 8, bytes[(xor(c, b) & 255) + 1]))) AS h
  FROM runs, crc),
words AS (
  SELECT CASE WHEN h % {DROPPED} = 0 THEN substr(low, 1, h % length(low)) || substr(low, h % length(low) + 2) ELSE low END AS word, sum(n)::BIGINT AS n
  FROM marked GROUP BY word HAVING length(word) >= {SHORTEST} AND sum(n) >= {SEEN}),
places AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
cuts AS (SELECT word, n, i, substr(word, 1, i) AS head, substr(word, i + 2) AS tail FROM places),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.head = b.head AND a.tail = b.tail AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON w.word = c.head || c.tail
  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON w.word = c.head || c.tail),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= {OFTEN} * w.n THEN b.other END AS form, CASE WHEN b.m >= {OFTEN} * w.n THEN b.m END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
walk AS (SELECT word, word AS here, 0 AS steps FROM forms UNION ALL SELECT k.word, f.form, k.steps + 1 FROM walk k JOIN forms f ON f.word = k.here WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(here, steps) AS root FROM walk GROUP BY word)
SELECT f.word, f.n, f.form, e.root, f.n_near, f.form_n FROM forms f JOIN ends e USING (word)
"""
