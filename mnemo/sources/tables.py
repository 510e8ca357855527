"""The driver's tables, and the ``memories`` relation derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemo import schema as S
from mnemo.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clock(spark: SparkSession, sf_dir: str) -> int:
    """The 'now' of a table's data, as a literal: five days after its last record."""
    last = table(spark, sf_dir, "documents").agg(F.max("doc_id")).first()[0] or 0
    return 1704067200 + last * 3600 + 432000


CHUNK = 1 << 16


def _two_before(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Adds ``_back1`` and ``_back2``: ``value`` of the two rows before each by ``order``, a number, within ``by``.

    Rows look back inside chunks of the order; the first rows of a chunk get theirs from the last rows of
    the chunks before, so a group with a third of all rows is many tasks' work.
    """
    df = df.withColumn("_chunk", F.floor(F.col(order) / CHUNK))
    inside = Window.partitionBy(*by, "_chunk").orderBy(order)
    own = F.struct(F.col(order).alias("o"), F.col(value).alias("v"))
    last = df.withColumn("_end", F.row_number().over(Window.partitionBy(*by, "_chunk").orderBy(F.desc(order)))).where("_end <= 2")
    ends = last.groupBy(*by, "_chunk").agg(F.max(F.when(F.col("_end") == 1, own)).alias("_l1"), F.max(F.when(F.col("_end") == 2, own)).alias("_l2"))
    chunks = Window.partitionBy(*by).orderBy("_chunk")
    before = F.array_compact(F.array(F.lag("_l1", 1).over(chunks), F.lag("_l2", 1).over(chunks), F.lag("_l1", 2).over(chunks)))
    ends = ends.select(*by, "_chunk", before.alias("_before"))
    out = df.withColumn("_n", F.row_number().over(inside)).withColumn("_a", F.lag(value, 1).over(inside)).withColumn("_b", F.lag(value, 2).over(inside)).join(ends, [*by, "_chunk"])
    earlier = lambda k: F.get("_before", F.lit(k))["v"]
    one = F.when(F.col("_n") == 1, earlier(0)).otherwise(F.col("_a"))
    two = F.when(F.col("_n") == 1, earlier(1)).when(F.col("_n") == 2, earlier(0)).otherwise(F.col("_b"))
    return out.withColumn("_back1", one).withColumn("_back2", two).drop("_chunk", "_n", "_a", "_b", "_before")


def memories(spark: SparkSession, sf_dir: str, vectors: bool = False, content: bool = True) -> DataFrame:
    """One record per document, with versions, statuses and links laid over it by rule.

    Rules run on narrow columns; bodies, where asked for, join in last.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    labels = table(spark, sf_dir, "labels")
    doc = F.col("doc_id")
    slot = (doc * 7 + F.floor(doc / 13)) % 10
    family = F.floor(doc / 20)
    narrow = docs.select("doc_id", "lang", "source", T.content_digest(F.col("text")).alias("digest"), F.substring("text", 1, 80).alias("start"))
    m = narrow.join(labels, "doc_id", "left").select(
        "doc_id",
        F.when(slot < 8, "shared").when(slot == 8, "private-a").otherwise("private-b").alias("index_name"),
        F.concat(F.lit("agent-"), doc % 7).alias("agent_id"), F.col("lang").alias("team_id"), F.col("source").alias("task_id"),
        F.element_at(F.array(*[F.lit(t) for t in ("episodic", "semantic", "procedural", "chunk", "document")]), (family % 5 + 1).cast("int")).alias("memory_type"),
        F.when(F.col("toxic") == 1, "external").otherwise("agent").alias("origin"),
        (doc * 3600 + 1704067200).alias("created_at"),
        F.when(doc % 11 == 0, doc * 3600 + 1704067200 + 864000).otherwise(F.lit(S.NO_EXPIRY)).alias("expires_at"),
        "digest", F.concat(F.lit("sha256:"), F.col("digest")).alias("content_hash"),
        F.when(family % 3 != 0, F.concat("source", F.lit(":"), F.substring("digest", 1, 16))).otherwise(F.concat("source", F.lit(":fam-"), F.floor(doc / 180))).alias("canonical_id"),
        F.col("quality").cast("double").alias("confidence"), "quality",
        F.when(doc % 4 != 3, F.col("start")).alias("content_summary"),
    )
    family_order = Window.partitionBy("index_name", "canonical_id").orderBy("doc_id")
    m = m.withColumn("version", F.row_number().over(family_order)).withColumn("_next", F.lead("doc_id").over(family_order))
    m = m.withColumn("status", F.when((F.col("quality") == 0) & (doc % 3 == 0), "archived").when(F.col("_next").isNull(), "active").otherwise("superseded"))
    m = m.withColumn("archived_at", F.when(F.col("status") == "archived", F.col("created_at") + 86400))
    m = m.withColumn("key", T.vector_key(F.col("agent_id"), F.col("task_id"), F.col("digest"), F.col("version")))
    m = m.withColumn("supersedes", F.lag("key").over(family_order))
    parents = m.where("memory_type = 'document'").groupBy("index_name", "task_id").agg(F.min_by("key", "doc_id").alias("_parent"))
    m = m.join(parents, ["index_name", "task_id"], "left").withColumn("parent_key", F.when(F.col("memory_type") == "chunk", F.col("_parent")))
    m = _two_before(m.withColumn("_task", F.coalesce("task_id", F.lit("\0"))), ["index_name", "_task"], "doc_id", "canonical_id").drop("_task")
    m = m.withColumn("linked_ids", F.array_compact(F.array("_back1", "_back2"))).drop("digest", "quality", "_next", "_parent", "_back1", "_back2")
    if content:
        m = m.join(docs.select("doc_id", F.col("text").alias("content")), "doc_id")
    if vectors:
        found = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
        n = max(1, found.count())
        m = m.join(found, F.col("doc_id") % n == F.col("vec_id"), "left").drop("vec_id")
    return m
