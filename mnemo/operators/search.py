"""Vector search: filtered and batch top-k, similarity pairs, collapse, promotion, ranking, retrieval."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemo import schema as S
from mnemo.functions import scoring, vectors
from mnemo.functions import text as T
from mnemo.operators import budget


def top_k(df: DataFrame, query: list[float], k: int, id_col: str, vector_col: str = "embedding", where: Column | None = None) -> DataFrame:
    """The k rows nearest to one vector: a filtered scan and a bounded per-task heap, no shuffle of rows."""
    found = df if where is None else df.where(where)
    return found.withColumn("distance", vectors.cosine_distance(F.col(vector_col), vectors.literal_vector(query))).orderBy("distance", id_col).limit(k)


def _units(values: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in values])
    size = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, size, out=np.full_like(m, np.nan), where=size > 0)


def batch_top_k(queries: DataFrame, base: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", by: list[str] | None = None) -> DataFrame:
    """(query_id, id, distance, rank) of each query's k nearest rows, exactly.

    Queries are broadcast, at most QUERY_BYTES of them at a time (counted first): rows stay where they
    are, each task keeps k of its rows a query, and a window merges those. More queries are more parts,
    and each part is one more scan of the rows; no vector is ever shuffled. For many queries, or rows by
    the billion, vector_index reads a few cells instead. ``by`` limits a query to rows that agree on these
    columns. Rows without a vector match nothing.
    """
    by = by or []
    queries, base = queries.where(F.col(vector_col).isNotNull()), base.where(F.col(vector_col).isNotNull())
    parts = query_parts(queries, vector_col)
    near = None
    for part in range(parts):
        some = queries if parts == 1 else queries.where(F.pmod(F.xxhash64(id_col, *by), F.lit(parts)) == part)
        found = _scan_top_k(some, base, k, id_col, vector_col, by)
        near = found if near is None else near.unionByName(found)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))).where(F.col("rank") <= k)


def query_parts(queries: DataFrame, vector_col: str) -> int:
    """How many broadcasts of at most QUERY_BYTES these vectors take."""
    n, width = queries.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(vector_col)), F.lit(0))).first()
    return max(1, -(-n * width * 8 // QUERY_BYTES))


QUERY_BYTES = 32 << 20


def _nearest(d: np.ndarray, ids: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each row of distances the positions of its k least, ties by identifier."""
    take = min(k, d.shape[1])
    edge = np.partition(d, take - 1, axis=1)[:, take - 1]
    for row, last in zip(d, edge, strict=True):
        near = np.flatnonzero(row <= last)
        yield near[np.lexsort((ids[near], row[near]))][:take]


def _scan_top_k(queries: DataFrame, base: DataFrame, k: int, id_col: str, vector_col: str, by: list[str]) -> DataFrame:
    spark = queries.sparkSession
    group = F.concat_ws("\x1f", *by) if by else F.lit("")
    asked = queries.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), group.alias("g")).toPandas()
    q_id, b_id = queries.schema[id_col].dataType.simpleString(), base.schema[id_col].dataType.simpleString()
    shape = f"query_id {q_id}, id {b_id}, distance double"
    parts: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for g, rows in asked.groupby("g"):
        parts[g] = rows["id"].to_numpy(), _units(rows["v"])
    shared = spark.sparkContext.broadcast(parts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            for g, rows in pdf.groupby("g", sort=False):
                if g not in shared.value:
                    continue
                x, ids = shared.value[g][1], rows["id"].to_numpy()
                y = _units(rows["v"])
                for at in range(0, len(x), 512):
                    d = np.round(1.0 - x[at : at + 512] @ y.T, 9)  # equal vectors tie exactly
                    d[np.isnan(d)] = np.inf
                    for r, near in enumerate(_nearest(d, ids, k), at):
                        dist, found = d[r - at][near], ids[near]
                        if (g, r) in held:
                            dist, found = np.concatenate([held[g, r][0], dist]), np.concatenate([held[g, r][1], found])
                            order = np.lexsort((found, dist))[:k]
                            dist, found = dist[order], found[order]
                        held[g, r] = dist, found
        for (g, r), (dist, found) in held.items():
            yield pd.DataFrame({"query_id": shared.value[g][0][r], "id": found, "distance": dist})

    rows = base.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), group.alias("g"))
    return rows.mapInPandas(run, shape).where("distance < 'Infinity'")


def similar_pairs(df: DataFrame, threshold: float, id_col: str = "vec_id", vector_col: str = "embedding", by: list[str] | None = None) -> DataFrame:
    """(a, b, similarity) with a < b and similarity at least the threshold, exactly.

    Vectors are broadcast in parts of at most QUERY_BYTES and compared where the rows lie: nothing but the
    pairs leaves a task. Work grows with the square of a group of ``by``; identifiers are unique.
    """
    group = F.concat_ws("\x1f", *by) if by else F.lit("")
    held = df.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), group.alias("g"))
    parts = query_parts(held, "v")
    out = None
    for part in range(parts):
        some = held if parts == 1 else held.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part)
        groups = {g: (rows["id"].to_numpy(), _units(rows["v"])) for g, rows in some.toPandas().groupby("g")}
        shared = df.sparkSession.sparkContext.broadcast(groups)

        def meet(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for g, rows in pdf.groupby("g", sort=False):
                    if g not in shared.value:
                        continue
                    p, x = shared.value[g]
                    q, y = rows["id"].to_numpy(), _units(rows["v"])
                    for at in range(0, len(x), 512):
                        c = x[at : at + 512] @ y.T
                        r, s = np.nonzero((c >= threshold) & (p[at : at + 512, None] < q[None, :]))
                        yield pd.DataFrame({"a": p[at + r], "b": q[s], "similarity": c[r, s]})

        found = held.mapInPandas(meet, "a long, b long, similarity double")
        out = found if out is None else out.unionByName(found)
    return out


def collapse_latest(hits: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One row per (by, canonical_id): highest (version, created_at), the first seen winning ties.

    The survivor takes the group's first position. Rows without a canonical_id stand for themselves.
    """
    group = F.coalesce(F.nullif("canonical_id", F.lit("")), F.col("key"))
    keyed = hits.withColumn("_group", group).withColumn("_order", F.struct(*order))
    best = Window.partitionBy(*by, "_group").orderBy(F.desc("version"), F.desc("created_at"), "_order")
    first = F.min("_order").over(Window.partitionBy(*by, "_group"))
    return keyed.withColumn("_first", first).withColumn("_rn", F.row_number().over(best)).where("_rn = 1").drop("_rn", "_order", "_group").withColumnRenamed("_first", "group_order")


def latest_view(mem: DataFrame) -> DataFrame:
    """The canonical index: the latest version of each canonical_id, over all statuses, by aggregation alone."""
    latest = F.max_by(F.struct("key", "version", "task_id", "agent_id", "memory_type", "status", "created_at"), F.struct("version", "created_at", "doc_id"))
    return mem.where("canonical_id IS NOT NULL").groupBy("index_name", "canonical_id").agg(latest.alias("r"), F.count(F.lit(1)).alias("n_versions")).select("index_name", "canonical_id", "r.*", "n_versions")


def promote_chunks(hits: DataFrame, mem: DataFrame, by: list[str]) -> DataFrame:
    """Chunk hits become their parent document, once per parent at its first chunk's place.

    Chunks without a parent_key are dropped; those whose parent is missing stay as chunks, each.
    Promoted parents are not screened again, so a parent hit directly may appear twice.
    """
    parents = mem.select("index_name", F.col("key").alias("_pkey"), F.struct(*[F.col(c) for c in mem.columns]).alias("_parent"))
    chunk = F.col("memory_type") == "chunk"
    joined = hits.where(~chunk | F.col("parent_key").isNotNull()).join(
        parents.withColumnRenamed("index_name", "_index"), chunk & (F.col("index_name") == F.col("_index")) & (F.col("parent_key") == F.col("_pkey")), "left"
    )
    promoted = F.col("_parent").isNotNull()
    order = Window.partitionBy(*by, "_pkey").orderBy("pos")
    kept = joined.withColumn("_n", F.when(promoted, F.row_number().over(order)).otherwise(1)).where("_n = 1")
    own = [c for c in hits.columns if c in mem.columns]
    return kept.select(*[F.when(promoted, F.col(f"_parent.{c}")).otherwise(F.col(c)).alias(c) if c in own else F.col(c) for c in hits.columns])


def mmr_order(hits: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Rank by diversified relevance, without a loop.

    Similarity to what is already chosen is 1 for the same canonical_id, 0.5 for the same task, else 0.
    Going down the scores, an item's penalty is settled by whether an earlier one shares its canonical
    or task, and the greedy order is the order of penalised scores. Holds where a canonical_id has one
    task; ``mmr_greedy`` is for the rest.
    """
    order = [F.desc(score), F.col("pos")]
    same_canonical = F.row_number().over(Window.partitionBy(*by, "canonical_id").orderBy(*order)) > 1
    same_task = F.row_number().over(Window.partitionBy(*by, "task_id").orderBy(*order)) > 1
    penalty = F.when(same_canonical & (F.coalesce("canonical_id", F.lit("")) != ""), F.lit(S.SAME_CANONICAL)).when(same_task & (F.coalesce("task_id", F.lit("")) != ""), F.lit(S.SAME_TASK)).otherwise(F.lit(0.0))
    ranked = hits.withColumn("mmr", F.lit(S.MMR_LAMBDA) * F.col(score) - F.lit(1 - S.MMR_LAMBDA) * penalty)
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("mmr"), "pos")))


def mmr_greedy(hits: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """The same order where one canonical_id may span tasks, which has no closed form: a fold over a query's hits.

    Each step takes the row of the largest mmr against all rows taken before, the first position
    winning ties. Work is cubic in the hits of one query (S.OVERSAMPLE at most), inside the JVM.
    """
    item = F.struct(F.col(score).cast("double").alias("s"), F.col("pos").cast("long").alias("pos"), F.coalesce("canonical_id", F.lit("")).alias("c"), F.coalesce("task_id", F.lit("")).alias("t"))
    listed = hits.groupBy(*by).agg(F.collect_list(item).alias("_items"))

    def alike(x: Column, y: Column) -> Column:
        return F.when((x["c"] == y["c"]) & (x["c"] != ""), F.lit(S.SAME_CANONICAL)).when((x["t"] == y["t"]) & (x["t"] != ""), F.lit(S.SAME_TASK)).otherwise(F.lit(0.0))

    def step(acc: Column, _: Column) -> Column:
        value = lambda x: F.lit(S.MMR_LAMBDA) * x["s"] - F.lit(1 - S.MMR_LAMBDA) * F.aggregate(acc["out"], F.lit(0.0), lambda m, y: F.greatest(m, alike(x, y["x"])))
        best = F.array_max(F.transform(acc["left"], lambda x: F.struct(value(x).alias("v"), (-x["pos"]).alias("first"), x.alias("x"))))
        taken = F.struct(best["x"].alias("x"), best["v"].alias("v"))
        return F.struct(F.filter(acc["left"], lambda x: x["pos"] != best["x"]["pos"]).alias("left"), F.concat(acc["out"], F.array(taken)).alias("out"))

    shape = "struct<s:double,pos:bigint,c:string,t:string>"
    start = F.struct(F.col("_items").alias("left"), F.expr(f"cast(array() as array<struct<x:{shape},v:double>>)").alias("out"))
    done = listed.select(*by, F.posexplode(F.aggregate(F.sequence(F.lit(1), F.size("_items")), start, step, lambda a: a["out"])).alias("_k", "_r"))
    return hits.join(done.select(*by, F.col("_r.x.pos").alias("pos"), F.col("_r.v").alias("mmr"), (F.col("_k") + 1).alias("rank")), [*by, "pos"])


def score_hits(hits: DataFrame, mode: str, now: int) -> DataFrame:
    if "use_count" not in hits.columns:
        hits = hits.withColumn("use_count", F.lit(0).cast("long")).withColumn("last_used_at", F.lit(0).cast("long"))
    score = scoring.base_score(mode, now, F.col("distance"), F.col("memory_type"), F.col("created_at"), F.col("confidence"), F.coalesce("use_count", F.lit(0)), F.col("last_used_at"))
    return hits.withColumn("score", F.round(score, 9))


def check_top_k(k: int, least: int = 1, most: int = S.SEARCH_TOP_K_MAX) -> int:
    if not least <= k <= most:
        raise ValueError(f"top_k must be between {least} and {most}")
    return k


def live(df: DataFrame, now: int) -> DataFrame:
    return df.where((F.col("status") == "active") & (F.col("expires_at") > now))


def retrieve(
    queries: DataFrame, mem: DataFrame, now: int, top: int = S.TOP_K, oversample: int = S.OVERSAMPLE, mode: str = "balanced", max_tokens: int = S.MAX_TOKENS, used: DataFrame | None = None,
    where: Column | None = None, level: str = "summary", wanted: DataFrame | None = None, scorer: Callable | None = None, nearest: Callable[[DataFrame, DataFrame, int], DataFrame] | None = None,
) -> DataFrame:
    """A batch of retrievals in one plan: nearest vectors, collapse, promotion, scores, diversity, budget.

    ``queries``: vec_id, embedding (and ``query``, its text, for a ``scorer``, which then ranks the
    hits instead of scores and diversity). ``where`` filters candidates by metadata; ``level`` is a detail
    level (budget.LEVELS); ``wanted`` (query_id, key, wanted_pos) names results to raise to whole
    bodies afterwards, in that order, as far as the budget goes. ``nearest`` (queries, candidates, k)
    finds candidates instead of a scan, as a stored index does. Bodies join in after the top rows are
    known. Adds rank, detail, tokens, used_tokens and, with ``wanted``, hydrated.
    """
    active = live(mem, now) if where is None else live(mem, now).where(where)
    near = (nearest or batch_top_k)(queries.select("vec_id", "embedding"), active.select(F.col("doc_id").alias("vec_id"), "embedding"), oversample)
    narrow = mem.drop("embedding", "content")
    hits = near.join(live(narrow, now), near["id"] == narrow["doc_id"]).drop("id").withColumnRenamed("rank", "pos")
    hits = collapse_latest(hits, ["query_id"], ["pos"]).withColumn("pos", F.col("group_order.pos")).drop("group_order")
    hits = promote_chunks(hits, narrow, ["query_id"])
    if used is not None:
        hits = hits.join(used, "canonical_id", "left")
    bodies = mem.select("doc_id", "content")
    if scorer is None:
        ranked = mmr_order(score_hits(hits, mode, now), ["query_id"])
    else:
        order = Window.partitionBy("query_id").orderBy("pos")
        asked = queries.select(F.col("vec_id").alias("query_id"), "query")
        ranked = rerank(hits.withColumn("pos", F.row_number().over(order)).join(asked, "query_id").join(bodies, "doc_id"), scorer, ["query_id"]).drop("content", "query")
    shown = ranked.where(F.col("rank") <= top).join(bodies, "doc_id")
    out = budget.at_level(shown, ["query_id"], "rank", level, max_tokens)
    if wanted is None:
        return out
    return raise_results(out.join(wanted, ["query_id", "key"], "left"), F.col("wanted_pos"), max_tokens)


def raise_results(results: DataFrame, wanted_pos: Column, max_tokens: int = S.MAX_TOKENS) -> DataFrame:
    """Results raised to whole bodies, in the order of ``wanted_pos`` where it isn't null, as far as the budget goes; adds hydrated."""
    raised = results.withColumn("wanted_pos", wanted_pos).withColumn("full_tokens", T.estimate_tokens(F.col("content")))
    return budget.hydrate_upgrade(raised, ["query_id"], "rank", max_tokens).drop("full_tokens", "wanted_pos")


def rerank(hits: DataFrame, scorer, by: list[str], query_col: str = "query", head: int = S.RERANK_HEAD) -> DataFrame:
    """Re-order the first ``head`` hits of each query by a pluggable scorer of (queries, texts) Series.

    A blank query or text leaves a hit where it was; the tail follows in its own order.
    """
    text = F.coalesce(F.nullif("content_summary", F.lit("")), F.nullif(F.substring("content", 1, S.RERANK_CHARS), F.lit("")), F.nullif("task_id", F.lit("")), "canonical_id", F.lit(""))

    @F.pandas_udf("double")
    def score(query: pd.Series, body: pd.Series) -> pd.Series:
        return pd.Series(scorer(query, body), dtype="float64")

    usable = (F.col("pos") <= head) & (F.trim(query_col) != "") & (text != "")
    scored = hits.withColumn("_s", F.when(usable, score(F.col(query_col), text)))
    order = Window.partitionBy(*by).orderBy(F.when(F.col("_s").isNotNull(), 0).when(F.col("pos") <= head, 1).otherwise(2), F.desc_nulls_last("_s"), "pos")
    return scored.withColumn("rank", F.row_number().over(order)).drop("_s")


def embed(texts: DataFrame, embedder, cache: DataFrame, now: int, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows with embedding, new cache rows): each distinct content is embedded once, cache first.

    ``embedder`` maps a Series of texts to a Series of float lists.
    """
    keyed = texts.withColumn("content_hash", T.content_hash(F.col(text_col)))
    fresh = cache.where(F.col("ttl_epoch") > now).select("content_hash", "embedding")
    misses = keyed.groupBy("content_hash").agg(F.min(text_col).alias(text_col)).join(fresh, "content_hash", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = embedder(batch.column(1).to_pandas())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(map(float, v)) for v in made], pa.list_(pa.float32()))], names=["content_hash", "embedding"])

    made = misses.select("content_hash", text_col).mapInArrow(run, "content_hash string, embedding array<float>")
    return keyed.join(fresh.unionByName(made), "content_hash", "left"), made.withColumn("ttl_epoch", F.lit(now + S.CACHE_TTL))
