"""A batch of writes classified as if its rows came one by one.

Within an index and task, rows are taken by ``seq``. A row is ``unchanged`` if a record with its content
hash is active by then, ``superseded`` if it names what it replaces, ``duplicate_detected`` if an active
record is near it, else ``created``. What earlier rows of the batch create counts, and what they
replace doesn't any more. So a row's outcome hangs on those before it: this is the first maximal
independent set, in order, of the graph of near rows. Rounds settle every row that no unsettled row
can sway: each round needs, for a row, only whether there is a record that surely counts or
one that may, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemo import schema as S
from mnemo.functions import text as T
from mnemo.operators import search
from mnemo.sources.shared import Work

NEVER = (1 << 63) - 1
FLAGS = "seq long, sure boolean, may boolean"
NEAREST = "seq long, found array<struct<d: double, key: string>>"


def _groups(rows: pd.DataFrame) -> dict[str, dict[str, np.ndarray]]:
    out = {}
    for g, some in rows.groupby("g"):
        some = some.sort_values("key")
        out[g] = {"v": search._units(some["v"]), "key": some["key"].to_numpy(), **{c: some[c].to_numpy(dtype=np.int64) for c in ("born", "sure", "until")}}
    return out


def scan(rows: DataFrame, base: DataFrame, similarity: float, top: int = 0) -> DataFrame:
    """For each row (seq, g, v) what of ``base`` (key, g, v, born, sure, until) is near it and counts at its time.

    A base row counts surely for born < seq <= sure, maybe up to ``until``. Without ``top`` the result is
    whether there is any of either kind; with it the ``top`` nearest sure ones. ``base`` is read in parts
    of at most search.QUERY_BYTES, each broadcast in turn; rows stay where they are.
    """
    spark = rows.sparkSession
    n, width = base.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    parts = max(1, -(-n * (width * 8 + 64) // search.QUERY_BYTES))
    out = None
    for part in range(parts):
        some = base.where(F.pmod(F.xxhash64("key", "born"), F.lit(parts)) == part).select("g", "key", F.col("v").cast("array<double>").alias("v"), "born", "sure", "until").toPandas()
        shared = spark.sparkContext.broadcast(_groups(some))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for g, asked in pdf.groupby("g", sort=False):
                    held = shared.value.get(g)
                    if held is None:
                        continue
                    seqs, x = asked["seq"].to_numpy(), search._units(asked["v"])
                    for at in range(0, len(x), 512):
                        d = np.round(1.0 - x[at : at + 512] @ held["v"].T, 9)
                        seq = seqs[at : at + 512, None]
                        near = (1.0 - d >= similarity) & (seq > held["born"])
                        sure = near & (seq <= held["sure"])
                        may = near & ~sure & (seq <= held["until"])
                        if top:
                            found = []
                            for r in range(len(d)):
                                k = np.flatnonzero(sure[r])
                                k = k[np.lexsort((k, d[r][k]))][:top]  # keys are in order
                                found.append([{"d": float(d[r][j]), "key": held["key"][j]} for j in k])
                            yield pd.DataFrame({"seq": seqs[at : at + 512], "found": found})
                        else:
                            yield pd.DataFrame({"seq": seqs[at : at + 512], "sure": sure.any(axis=1), "may": may.any(axis=1)})

        made = rows.select("seq", "g", F.col("v").cast("array<double>").alias("v")).mapInPandas(run, NEAREST if top else FLAGS)
        out = made if out is None else out.unionByName(made)
    if top:
        every = F.flatten(F.collect_list("found"))
        return out.groupBy("seq").agg(F.slice(F.array_sort(every), 1, top).alias("found"))
    return out.groupBy("seq").agg(F.bool_or("sure").alias("sure"), F.bool_or("may").alias("may"))


def classify(incoming: DataFrame, mem: DataFrame, similarity: float = S.NEAR_DUPLICATE, top_k: int = S.DEDUP_TOP_K) -> DataFrame:
    """Adds ``action``, ``match_key`` and ``near_keys`` to rows (seq, index_name, task_id, embedding, content_hash, supersedes_key, mode, agent_id, ...).

    ``match_key`` is the first key of an equal content, the key that is replaced, or the nearest near
    one; ``near_keys`` are the ``top_k`` nearest active ones of similarity at least ``similarity``,
    nearest first. ``seq`` must be unique. Rows without a vector are near nothing; expiry doesn't count.
    A key to replace that doesn't exist is an error, but that check belongs to the writer.
    """
    spark = incoming.sparkSession
    work = Work(spark, "writes")
    group = F.concat_ws("\x1f", "index_name", F.coalesce("task_id", F.lit("\0")))
    rows = incoming.select("seq", group.alias("g"), "index_name", "content_hash", F.col("embedding").alias("v"), "supersedes_key", F.coalesce("mode", F.lit("auto")).alias("mode"), "agent_id", "task_id")
    rows = work.written(rows.withColumn("seq", F.col("seq").cast("long")))
    active = mem.where("status = 'active'").select(group.alias("g"), "index_name", "key", "content_hash", F.col("embedding").alias("v"))
    targets = rows.where("supersedes_key IS NOT NULL").select("index_name", F.col("supersedes_key").alias("key"))
    # stored records that no row of the batch replaces never change: searched once
    firm = active.join(targets, ["index_name", "key"], "left_anti")
    contested = work.written(active.join(targets, ["index_name", "key"], "left_semi"))
    near = search.batch_top_k(rows.select(F.col("seq").alias("key"), "g", F.col("v").alias("embedding")), firm.select("key", "g", F.col("v").alias("embedding")), top_k, "key", by=["g"])
    near = near.where(1 - F.col("distance") >= similarity).groupBy(F.col("query_id").alias("seq")).agg(F.array_sort(F.collect_list(F.struct(F.col("distance").alias("d"), F.col("id").alias("key")))).alias("stored_near"))
    same = firm.groupBy("g", "content_hash").agg(F.min("key").alias("stored_key"))
    rows = work.written(rows.join(near, "seq", "left").join(same, ["g", "content_hash"], "left"))

    unsettled = rows.withColumn("near_yes", F.col("stored_near").isNotNull())
    settled = work.written(rows.limit(0).select("seq", F.lit("").alias("action")))
    while True:
        acts = rows.join(settled, "seq")
        made = acts.where("action IN ('created', 'superseded')").select("g", F.col("seq").cast("string").alias("key"), "content_hash", "v", F.col("seq").alias("born"), F.lit(NEVER).alias("sure"), F.lit(NEVER).alias("until"))
        could = unsettled.where("stored_key IS NULL AND NOT (near_yes AND supersedes_key IS NULL AND mode <> 'new')")
        may = could.select("g", F.col("seq").cast("string").alias("key"), "content_hash", "v", F.col("seq").alias("born"), F.lit(-1).cast("long").alias("sure"), F.lit(NEVER).alias("until"))
        # a contested record surely counts up to the first row that may replace it, and at most up to the first that does
        will = acts.where("action = 'superseded'").select("index_name", F.col("supersedes_key").alias("key"), "seq", F.lit(True).alias("done"))
        might = unsettled.where("supersedes_key IS NOT NULL AND stored_key IS NULL").select("index_name", F.col("supersedes_key").alias("key"), "seq", F.lit(False).alias("done"))
        ends = will.unionByName(might).groupBy("index_name", "key").agg(F.min("seq").alias("sure"), F.min(F.when(F.col("done"), F.col("seq"))).alias("until"))
        spans = contested.join(ends, ["index_name", "key"], "left").select("g", "key", "content_hash", "v", F.lit(-1).cast("long").alias("born"), F.coalesce("sure", F.lit(NEVER)).alias("sure"), F.coalesce("until", F.lit(NEVER)).alias("until"))
        base = work.written(made.unionByName(may).unionByName(spans))

        by_hash = base.groupBy("g", "content_hash").agg(F.min(F.when(F.col("sure") == NEVER, F.col("born"))).alias("_made"), F.min(F.when(F.col("sure") == -1, F.col("born"))).alias("_may"), F.max(F.when(F.col("born") == -1, F.col("sure"))).alias("_sure"), F.max(F.when(F.col("born") == -1, F.col("until"))).alias("_until"))
        plain = unsettled.where("supersedes_key IS NULL AND mode <> 'new' AND NOT near_yes")
        flags = scan(plain.where("v IS NOT NULL"), base.where("v IS NOT NULL"), similarity)
        seq = F.col("seq")
        yes = lambda c: F.coalesce(c, F.lit(False))
        here = unsettled.join(by_hash, ["g", "content_hash"], "left").join(flags, "seq", "left")
        same_yes = F.col("stored_key").isNotNull() | yes(F.col("_made") < seq) | yes(seq <= F.col("_sure"))
        same_may = yes(F.col("_may") < seq) | yes(seq <= F.col("_until"))
        near_yes = F.col("near_yes") | yes(F.col("sure"))
        action = (
            F.when(same_yes, "unchanged").when(same_may, None).when(F.col("supersedes_key").isNotNull(), "superseded").when(F.col("mode") == "new", "created")
            .when(near_yes, "duplicate_detected").when(yes(F.col("may")), None).otherwise("created")
        )
        here = work.written(here.select(*rows.columns, near_yes.alias("near_yes"), action.alias("action")))
        settled = work.written(settled.unionByName(here.where("action IS NOT NULL").select("seq", "action")))
        unsettled = here.where("action IS NULL").drop("action")
        if unsettled.isEmpty():
            break

    acts = work.written(rows.join(settled, "seq"))
    old = mem.select("index_name", F.col("key").alias("supersedes_key"), F.col("version").alias("_v"))
    made = acts.where("action IN ('created', 'superseded')").join(old, ["index_name", "supersedes_key"], "left")
    key = T.vector_key(F.col("agent_id"), F.col("task_id"), F.substring_index("content_hash", ":", -1), F.when(F.col("action") == "created", 1).otherwise(F.coalesce("_v", F.lit(1)) + 1))
    made = made.select("g", key.alias("key"), "content_hash", "v", F.col("seq").alias("born"), F.lit(NEVER).alias("sure"), F.lit(NEVER).alias("until"))
    gone = acts.where("action = 'superseded'").groupBy("index_name", F.col("supersedes_key").alias("key")).agg(F.min("seq").alias("until"))
    spans = contested.join(gone, ["index_name", "key"], "left").withColumn("until", F.coalesce("until", F.lit(NEVER)))
    base = work.written(made.unionByName(spans.select("g", "key", "content_hash", "v", F.lit(-1).cast("long").alias("born"), F.col("until").alias("sure"), "until")))
    found = scan(acts.where("action = 'duplicate_detected' AND v IS NOT NULL"), base.where("v IS NOT NULL"), similarity, top_k)
    # the first equal content: contents that are made have few keys each, so this join's rows are few
    copies = acts.where("action = 'unchanged'").join(base.select("g", "content_hash", F.col("key").alias("_key"), "born", "until"), ["g", "content_hash"]).where("born < seq AND seq <= until").groupBy("seq").agg(F.min("_key").alias("made_key"))
    none = F.expr("cast(array() as array<struct<d: double, key: string>>)")
    nearest = F.slice(F.array_sort(F.concat(F.coalesce("stored_near", none), F.coalesce("found", none))), 1, top_k)
    out = acts.join(found, "seq", "left").join(copies, "seq", "left").withColumn("near_keys", F.when(F.col("action") == "duplicate_detected", F.transform(nearest, lambda x: x["key"])).otherwise(F.expr("cast(array() as array<string>)")))
    match = F.when(F.col("action") == "unchanged", F.least("stored_key", "made_key")).when(F.col("action") == "superseded", F.col("supersedes_key")).when(F.col("action") == "duplicate_detected", F.get("near_keys", F.lit(0)))
    out = work.written(out.select("seq", "action", match.alias("match_key"), "near_keys"))
    work.close(out)
    return incoming.withColumn("seq", F.col("seq").cast("long")).join(out, "seq")
