"""Exact deduplication by a tree-merge of sorted digest runs (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemo.llm.common import ascii_lower, join_small, written

KEY = ["digest", "n_bytes", "proof"]
RUN_ROWS = 20_000
FAN = 16


def runs_for(rows: int) -> int:
    """Runs of about RUN_ROWS documents, a power of two of them: they grow with the table."""
    return 1 << max(1, (max(1, rows) // RUN_ROWS).bit_length())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document: its SHA-256 digest, and two values that verify the digest."""
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), norm.alias("norm")).select(
        "doc_id",
        F.sha2("norm", 256).alias("digest"),
        F.octet_length("norm").alias("n_bytes"),
        F.xxhash64("norm").alias("proof"),
    )


def in_runs(prints: DataFrame, runs: int) -> DataFrame:
    return prints.withColumn("run", F.pmod(F.xxhash64("doc_id"), F.lit(runs)).cast("int"))


def tree_merge(prints: DataFrame, runs: int, keep: str = "max") -> list[DataFrame]:
    """Merge the runs' digest tables in rounds of FAN runs each; returns the tree's levels, leaves first.

    A leaf is a run's row for a digest, pre-aggregated where documents are read. In each round the runs of
    one number but for its last four bits are exchanged to one place by digest, laid in one sorted order and
    merged in it: of neighbours whose digest, byte length and second hash all agree, the one with
    the smallest (or largest) identifier is retained with the sum of their counts. No merge ever meets
    more than FAN rows of one digest, whatever share of the table holds it, and n runs take log16(n)
    rounds. Null identifiers lose to any other. The last level has the one run 0.
    """
    best = F.max if keep == "max" else F.min
    levels = [prints.groupBy("run", *KEY).agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))]
    first = F.desc_nulls_last("keep_id") if keep == "max" else F.asc_nulls_last("keep_id")
    order = Window.partitionBy("run", *KEY).orderBy(first)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = runs
    while left > 1:
        left = -(-left // FAN)
        merged = levels[-1].withColumn("run", F.floor(F.col("run") / FAN).cast("int")).withColumn("_nth", F.row_number().over(order)).withColumn("group_size", F.sum("group_size").over(every))
        level = merged.where("_nth = 1").drop("_nth")
        levels.append(written(level, "dedup-level") if left > 1 else level)
    return levels


def verdicts(levels: list[DataFrame]) -> DataFrame:
    """(run, digest, ...) of every leaf with its whole group's verdict, sent down the tree as it came up.

    A level's rows take the verdict of the row of the next level that they were merged into, so at most FAN
    of them meet one.
    """
    told = levels[-1]
    for level in reversed(levels[:-1]):
        up = told.withColumnRenamed("run", "_up")
        told = level.drop("keep_id", "group_size").withColumn("_up", F.floor(F.col("run") / FAN).cast("int")).join(up, ["_up", *KEY]).drop("_up")
    return told


def exact_dedup(docs: DataFrame, runs: int | None = None, keep: str = "max", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with its group of equal texts and whether it is the one that stays.

    Texts are equal when identical after lower-casing A-Z only. Null text counts as empty; an empty
    table gives an empty result; other columns are ignored. Rows that repeat an identifier and its
    text are counted each and share their decision; null identifiers lose to any other (keep_id is
    null only if the whole group has none). Verdicts travel back down the tree, level by level, and
    from a leaf to its run's documents, so no join meets a whole group at one key.
    """
    prints = written(fingerprints(docs, id_col, text_col), "dedup-prints")
    runs = runs or runs_for(prints.count())
    prints = in_runs(prints, runs)
    told = verdicts(tree_merge(prints, runs, keep))
    return prints.join(told, ["run", *KEY]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def kept_documents(docs: DataFrame, runs: int | None = None, keep: str = "max") -> DataFrame:
    """The documents that stay: one row for each distinct text, with all columns of ``docs``.

    Of rows that repeat an identifier and its text one stays, whichever; of a group without
    identifiers, too. Columns may have any names; an empty table stays empty. Only the few (identifier,
    digest) pairs that go, or that repeat, are joined to texts, by broadcast while they are small.
    """
    prints = written(fingerprints(docs), "dedup-prints")
    runs = runs or runs_for(prints.count())
    root = tree_merge(in_runs(prints, runs), runs, keep)[-1]
    several = written(root.where("group_size > 1").select("digest", "keep_id"), "dedup-groups")
    pairs = join_small(prints.select("doc_id", "digest"), several, "digest", "inner", spread="doc_id")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    marked = pairs.groupBy(F.xxhash64(F.col("doc_id"), F.isnull("doc_id")).alias("_id"), F.col("digest").alias("_digest")).agg(F.max(kept).alias("_kept"), F.count(F.lit(1)).alias("_n"))
    marked = written(marked.where("NOT _kept OR _n > 1"), "dedup-marked")
    norm = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    ident = F.col("doc_id").cast("long")
    rows = docs.select(F.struct("*").alias("_row"), F.xxhash64(ident, F.isnull(ident)).alias("_id"), F.sha2(norm, 256).alias("_digest"))
    out = join_small(rows, marked, ["_id", "_digest"], "left_anti").select("_row.*")
    again = marked.where("_kept").select("_id", "_digest")
    if again.isEmpty():
        return out
    one = F.row_number().over(Window.partitionBy("_id", "_digest").orderBy("_digest"))
    return out.unionByName(join_small(rows, again, ["_id", "_digest"], "left_semi").withColumn("_nth", one).where("_nth = 1").select("_row.*"))


SQL = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
           FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
