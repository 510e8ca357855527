"""Merkle manifest of a dataset: hash trees whose parents retain the hash state before each child slot.

Every document is a leaf, every source a tree of runs of three, and the sources' roots are the leaves
of one more tree, the forest. A parent keeps a copy of its running SHA-256 state before each of its
children; ``midstate`` makes such a state 32 bytes. To put another value in a slot, the state before
it is resumed with the replacement and the siblings to its right; what lies to the left is not read.

Trees are cut into blocks of 3^8 nodes, eight levels deep, so no group is larger whatever share of
the table a source holds. A block is one row of the manifest: the digests of its levels and its
parents' states. Rounds go up from blocks to blocks of their tops until each tree has one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemo.llm import midstate
from mnemo.llm.common import join_small, written

FAN = 3
LEVELS = 8
STEPS = "array<struct<state: binary, left: binary, right: binary>>"
BLOCK = "tree string, block long, n long, digests array<binary>, states array<binary>, top binary"


def field(value: Column) -> Column:
    """A dash for null, else the value's length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, (doc_id, source, lang, n_chars, text))), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, tree, leaf, fresh): a document's digest, and its digest as found later, null if nothing was changed.

    The change to be found deletes the line feeds of texts whose crc32(doc_id as decimal) is even.
    Trees are named by "=" and the source, or "" without a source: in that order, bytewise.
    """
    of = lambda text: leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    text = F.col("text")
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & (F.instr(text, "\n") > 0)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source"))).alias("tree"),
        of(text).alias("leaf"),
        F.when(hit, of(F.replace(text, F.lit("\n"), F.lit("")))).alias("fresh"),
    )


def placed(nodes: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Adds ``pos``, a node's place in its tree by ``order``, and ``n``, the nodes of its tree.

    Rows are laid in ranges of (tree, order) once and written; what a tree has in earlier ranges comes
    from one count for each tree and range, so no window meets more rows than there are ranges.
    """
    at = F.col("_at")
    cut = nodes.withColumn("_any", F.monotonically_increasing_id()).repartitionByRange("tree", *order, "_any").drop("_any")
    rows = written(cut.sortWithinPartitions("tree", *order).withColumn("_at", F.monotonically_increasing_id()), name)
    rows = rows.withColumn("_range", F.shiftright(at, 33)).withColumn("_at", at.bitwiseAND(F.lit((1 << 33) - 1)))
    counts = rows.groupBy("tree", "_range").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy("tree").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("tree", "_range", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_base"), F.sum("_rows").over(Window.partitionBy("tree")).alias("n"))
    return join_small(rows, written(bases, name + "-bases"), ["tree", "_range"], "inner").withColumn("pos", at + F.col("_base")).drop("_at", "_range", "_base")


def levels_of(n: int, most: int) -> int:
    """Levels above ``n`` nodes inside one block."""
    k = 0
    while n > 1 and k < most:
        n, k = -(-n // FAN), k + 1
    return k


def parents(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parents of a level, and their states before the second and the third child: (p, 2, 8)."""
    count = -(-len(digests) // FAN)
    states, kept = midstate.start(count), []
    for slot in range(FAN):
        there = np.arange(count) * FAN + slot < len(digests)
        if slot:
            kept.append(states)
        full = np.zeros((count, 8), dtype=np.uint32)
        full[there] = digests[slot::FAN]
        states = midstate.absorb(states, full, there)
    sizes = np.minimum(FAN, len(digests) - np.arange(count) * FAN)
    return midstate.finish(states, sizes), np.stack(kept, axis=1)


def grow_block(levels: int, key: tuple, nodes: pa.Table) -> pa.Table:
    """One block of the manifest from its nodes."""
    nodes = nodes.sort_by("pos")
    n = nodes["n"][0].as_py()
    level = midstate.from_bytes(b"".join(nodes["digest"].to_pylist()))
    digests, states = [midstate.to_bytes(level)], []
    for _ in range(levels_of(n, levels)):
        level, kept = parents(level)
        digests.append(midstate.to_bytes(level))
        states.append(midstate.to_bytes(kept.reshape(-1, 8)))
    row = {"tree": [key[0].as_py()], "block": [key[1].as_py()], "n": [n], "digests": [digests], "states": [states], "top": [digests[-1]]}
    return pa.table(row, schema=BLOCK_ARROW)


BLOCK_ARROW = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("digests", pa.list_(pa.binary())), ("states", pa.list_(pa.binary())), ("top", pa.binary())])
PATH_ARROW = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("pos", pa.int64()), ("own", pa.list_(pa.struct([("state", pa.binary()), ("left", pa.binary()), ("right", pa.binary())])))])


def climb(nodes: DataFrame, name: str, levels: int = LEVELS) -> list[DataFrame]:
    """The manifest of (tree, pos, n, digest): one written table of blocks a round, from the leaves up."""
    rounds: list[DataFrame] = []
    width = FAN**levels
    grow = lambda key, nodes: grow_block(levels, key, nodes)
    while True:
        blocks = nodes.select("tree", "pos", "n", "digest", F.floor(F.col("pos") / width).alias("block")).groupBy("tree", "block").applyInArrow(grow, BLOCK)
        rounds.append(written(blocks, f"{name}-{len(rounds)}"))
        nodes = rounds[-1].where(F.col("n") > width).select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / width).alias("n"), F.col("top").alias("digest"))
        if nodes.isEmpty():
            return rounds


def roots(rounds: list[DataFrame], levels: int = LEVELS) -> DataFrame:
    """(tree, digest) of every tree; a lone leaf is its tree's root."""
    done = [r.where(F.col("n") <= FAN**levels).select("tree", F.col("top").alias("digest")) for r in rounds]
    for more in done[1:]:
        done[0] = done[0].unionByName(more)
    return done[0]


class Block:
    """A block's levels as arrays."""

    def __init__(self, digests: list[bytes], states: list[bytes]):
        self.digests = [midstate.from_bytes(x) for x in digests]
        self.states = [midstate.from_bytes(x).reshape(-1, FAN - 1, 8) for x in states]

    def before(self, level: int, at: np.ndarray) -> np.ndarray:
        """The retained states of the parents of nodes ``at``, each before its node's slot."""
        slot, states = at % FAN, midstate.start(len(at))
        later = slot > 0
        states[later] = self.states[level][at[later] // FAN, slot[later] - 1]
        return states


def paths_in(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each node of a block the steps to its top: state before its slot, left and right siblings."""
    for batch in batches:
        for row in batch.to_pylist():
            block = Block(row["digests"], row["states"])
            nodes = len(block.digests[0])
            own: list[list] = [[] for _ in range(nodes)]
            at = np.arange(nodes)
            for level in range(len(block.states)):
                states, row_digests = block.before(level, at), block.digests[level]
                for k in range(nodes):
                    first = int(at[k]) // FAN * FAN
                    left, right = row_digests[first : at[k]], row_digests[at[k] + 1 : first + FAN]
                    own[k].append({"state": midstate.to_bytes(states[k]), "left": midstate.to_bytes(left), "right": midstate.to_bytes(right)})
                at = at // FAN
            pos = row["block"] * width + np.arange(nodes)
            for a in range(0, nodes, 512):
                some = own[a : a + 512]
                yield pa.RecordBatch.from_pydict({"tree": [row["tree"]] * len(some), "block": [row["block"]] * len(some), "pos": pos[a : a + 512], "own": some}, schema=PATH_ARROW)


def paths(rounds: list[DataFrame], name: str, levels: int = LEVELS) -> DataFrame | None:
    """(tree, pos, steps) of the lowest round's nodes: all steps to the root of their tree. None without rounds."""
    above = None
    for k, blocks in reversed(list(enumerate(rounds))):
        own = blocks.mapInArrow(lambda batches: paths_in(FAN**levels, batches), f"tree string, block long, pos long, own {STEPS}")
        if above is None:
            steps = own.select("tree", "pos", F.col("own").alias("steps"))
        else:
            over = above.select("tree", F.col("pos").alias("block"), F.col("steps").alias("_over"))
            steps = own.join(over, ["tree", "block"], "left").select("tree", "pos", F.concat("own", F.coalesce("_over", F.array().cast(STEPS))).alias("steps"))
        above = written(steps, f"{name}-paths-{k}")
    return above


def fold(block: Block, at: np.ndarray, leaf: np.ndarray, above: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """(roots, proofs): what the root becomes with ``leaf`` at places ``at``, and the digest of all siblings on the way."""
    proof, read = midstate.start(len(at)), np.zeros(len(at), dtype=np.int64)
    for level, states in enumerate(block.states):
        row, first, slot = block.digests[level], at // FAN * FAN, at % FAN
        size = np.minimum(FAN, len(row) - first)
        state = midstate.absorb(block.before(level, at), leaf)
        for k in range(FAN):
            there = (k < size) & (k != slot)
            sibling = row[np.minimum(first + k, len(row) - 1)]
            proof = midstate.absorb(proof, sibling, there)
            state = midstate.absorb(state, sibling, there & (k > slot))
            read += there
        leaf, at = midstate.finish(state, size), at // FAN
    for step in above:
        left, right = midstate.from_bytes(step["left"]), midstate.from_bytes(step["right"])
        state = midstate.absorb(np.repeat(midstate.from_bytes(step["state"]), len(leaf), axis=0), leaf)
        for sibling in left:
            proof = midstate.absorb(proof, np.repeat(sibling[None], len(leaf), axis=0))
        for sibling in right:
            every = np.repeat(sibling[None], len(leaf), axis=0)
            proof, state = midstate.absorb(proof, every), midstate.absorb(state, every)
        read += len(left) + len(right)
        leaf = midstate.finish(state, np.full(len(leaf), len(left) + 1 + len(right)))
    return leaf, midstate.finish(proof, read)


FOLDED = pa.schema([("doc_id", pa.int64()), ("leaf", pa.binary()), ("subroot", pa.binary()), ("proof", pa.binary()), ("folded", pa.binary())])


def fold_block(width: int, key: tuple, rows: pa.Table, blocks: pa.Table) -> pa.Table:
    at = rows["pos"].to_numpy() - key[1].as_py() * width
    if not len(at):
        return FOLDED.empty_table()
    block = Block(blocks["digests"][0].as_py(), blocks["states"][0].as_py())
    folded, proof = fold(block, at, midstate.from_bytes(b"".join(rows["later"].to_pylist())), blocks["steps"][0].as_py())
    cells = lambda x: pa.array([r.tobytes() for r in x.astype(">u4")], pa.binary())
    return pa.table([rows["doc_id"].combine_chunks(), rows["leaf"].combine_chunks(), pa.array([blocks["subroot"][0].as_py()] * len(at), pa.binary()), cells(proof), cells(folded)], schema=FOLDED)


def manifest(docs: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, list[DataFrame], DataFrame, list[DataFrame]]:
    """(placed leaves, rounds of the sources' trees, placed subroots, rounds of the forest), all written."""
    rows = placed(leaves(docs), ["doc_id", "leaf"], "merkle-leaves")
    trees = climb(rows.withColumnRenamed("leaf", "digest"), "merkle-trees", levels)
    subroots = placed(roots(trees, levels).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"], "merkle-subroots")
    return rows, trees, subroots, climb(subroots, "merkle-forest", levels)


def verify(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Every document's leaf, subroot, root and proof, and the root that its present text folds to.

    The manifest is made of all documents as they are; then the line feeds of half the texts are
    deleted, and each such leaf is folded to the root from the states its ancestors retain.
    One row per row of ``docs``; nulls are part of the leaf; rows without doc_id come first in their
    source and are never tampered with; rows that repeat are leaves each, those of one doc_id in the
    order of their digests. An empty table gives an empty result; other columns are ignored.
    """
    rows, trees, subroots, forest = manifest(docs, levels)
    root = roots(forest, levels).first()
    root_hex = F.lit(root["digest"].hex() if root else None).cast("string")
    inner, outer = paths(trees[1:], "merkle-trees", levels), paths(forest, "merkle-forest", levels)
    width = FAN**levels
    fold_rows = lambda key, rows, blocks: fold_block(width, key, rows, blocks)
    empty = F.array().cast(STEPS)
    over = outer.join(subroots.select("tree", "pos", "name", "digest"), ["tree", "pos"]).select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), F.col("steps").alias("_outer"))
    blocks = trees[0].select("tree", "block", "digests", "states")
    if inner is not None:
        blocks = blocks.join(inner.select("tree", F.col("pos").alias("block"), F.col("steps").alias("_inner")), ["tree", "block"], "left")
    else:
        blocks = blocks.withColumn("_inner", empty)
    blocks = join_small(blocks, written(over, "merkle-over"), "tree", "inner", spread="block")
    blocks = blocks.select("tree", "block", "digests", "states", "subroot", F.concat(F.coalesce("_inner", empty), F.col("_outer")).alias("steps"))
    found = rows.select("tree", F.floor(F.col("pos") / width).alias("block"), "pos", "doc_id", "leaf", F.coalesce("fresh", "leaf").alias("later"))
    out = found.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(fold_rows, "doc_id long, leaf binary, subroot binary, proof binary, folded binary")
    text = lambda c: F.lower(F.hex(c))
    return out.select(
        "doc_id",
        text("leaf").alias("leaf"),
        text("subroot").alias("subroot"),
        root_hex.alias("root"),
        text("proof").alias("proof_sha256"),
        text("folded").alias("folded_root"),
        (text("folded") == root_hex).alias("verified"),
    )


def sql() -> str:
    """The same rows in SQL, on all levels at once and without retained states."""
    shown = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"
    leaf = lambda text: "sha256(" + " || ".join([shown(c) for c in ("doc_id", "source", "lang", "n_chars")] + [shown(text)]) + ")"
    return f"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))) ORDER BY b) AS bytes FROM range(256) r(b)),
d AS (
  SELECT doc_id, source, {leaf("text")} AS leaf, {leaf("replace(text, chr(10), '')")} AS changed,
         coalesce(xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda c, b: xor(c >> 8, bytes[(xor(c, b) & 255) + 1]))) % 2 = 0, false) AS hit
  FROM documents, crc),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, row_number() OVER () AS id FROM d),
nodes AS (
  SELECT source, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM leaves
  UNION ALL
  SELECT source, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 2) // 3)
  FROM nodes WHERE n > 1 GROUP BY source, level, pos // 3),
subroots AS (
  SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
forest AS (
  SELECT 0 AS level, pos, h, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 2) // 3) FROM forest WHERE n > 1 GROUP BY level, pos // 3),
runs AS (SELECT source, level, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM nodes WHERE n > 1 GROUP BY source, level, pos // 3),
forest_runs AS (SELECT level, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM forest WHERE n > 1 GROUP BY level, pos // 3),
walk AS (
  SELECT id, source, 0 AS level, pos, CASE WHEN hit THEN changed ELSE leaf END AS h, '' AS proof FROM leaves
  UNION ALL
  SELECT w.id, w.source, w.level + 1, w.pos // 3,
         sha256(array_to_string(list_transform(r.hs, lambda x, i: CASE WHEN i = w.pos % 3 + 1 THEN w.h ELSE x END), '')),
         w.proof || array_to_string(list_filter(r.hs, lambda x, i: i <> w.pos % 3 + 1), '')
  FROM walk w JOIN runs r ON r.source IS NOT DISTINCT FROM w.source AND r.level = w.level AND r.run = w.pos // 3),
at_top AS (SELECT id, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM walk GROUP BY id),
over_forest AS (
  SELECT t.id, 0 AS level, s.pos, t.h, t.proof FROM at_top t JOIN leaves l ON l.id = t.id JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source
  UNION ALL
  SELECT w.id, w.level + 1, w.pos // 3,
         sha256(array_to_string(list_transform(r.hs, lambda x, i: CASE WHEN i = w.pos % 3 + 1 THEN w.h ELSE x END), '')),
         w.proof || array_to_string(list_filter(r.hs, lambda x, i: i <> w.pos % 3 + 1), '')
  FROM over_forest w JOIN forest_runs r ON r.level = w.level AND r.run = w.pos // 3),
folded AS (SELECT id, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM over_forest GROUP BY id)
SELECT l.doc_id, l.leaf, s.h AS subroot, f.h AS root, sha256(x.proof) AS proof_sha256, x.h AS folded_root, x.h = f.h AS verified
FROM leaves l JOIN folded x ON x.id = l.id JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source CROSS JOIN (SELECT h FROM forest WHERE n = 1) f
"""
