"""Time-based sweeps: promotion, deletion, drift repair, and the guard on deletions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo import schema as S
from mnemo.operators.search import latest_view
from mnemo.sources.shared import Work


class CircuitBreaker(RuntimeError):
    """A sweep would delete more than its cap allows; nothing was deleted."""


def promote_superseded(mem: DataFrame, now: int, grace: int = S.SUPERSEDED_GRACE) -> DataFrame:
    """Superseded records as they are once archived: those of canonical_ids that nothing was written to for ``grace``.

    The time that counts is the canonical row's, which each new version sets anew.
    """
    rows = latest_view(mem).where(F.lit(now) - F.col("created_at") >= grace).select("index_name", "canonical_id")
    due = mem.where("status = 'superseded'").join(rows, ["index_name", "canonical_id"], "left_semi")
    return due.withColumn("status", F.lit("archived")).withColumn("archived_at", F.lit(now))


def delete_archived(mem: DataFrame, now: int, grace: int = S.ARCHIVED_GRACE) -> DataFrame:
    return mem.where((F.col("status") == "archived") & (F.lit(now) - F.col("archived_at") >= grace)).withColumn("reason", F.lit("archived"))


def delete_expired(mem: DataFrame, now: int) -> DataFrame:
    return mem.where(F.col("expires_at") <= now).withColumn("reason", F.lit("expired"))


def reap(ttl: DataFrame, mem: DataFrame, now: int) -> DataFrame:
    """(index_name, key, expires_at, found): the rows of a table of expiries that are due, and whether their record is still there.

    Those found are to be deleted; all of them leave the table of expiries, whose records may be long gone.
    """
    due = ttl.where(F.col("expires_at") <= now).select("index_name", "key", "expires_at")
    there = mem.select("index_name", "key", F.lit(True).alias("_there")).distinct()
    return due.join(there, ["index_name", "key"], "left").withColumn("found", F.coalesce("_there", F.lit(False))).drop("_there")


def breaker_status(mem: DataFrame, doomed: DataFrame, cap: int = S.DELETE_CAP, share: float = S.DELETE_CAP_SHARE) -> DataFrame:
    """Per index: size, deletions asked for, the cap, and whether it trips."""
    sizes = mem.groupBy("index_name").agg(F.count(F.lit(1)).alias("index_size"))
    asked = doomed.groupBy("index_name").agg(F.countDistinct("key").alias("n_delete"))
    out = sizes.join(asked, "index_name", "left").withColumn("n_delete", F.coalesce("n_delete", F.lit(0)))
    out = out.withColumn("cap", F.greatest(F.lit(cap), F.floor(F.lit(share) * F.col("index_size"))).cast("long"))
    return out.withColumn("tripped", F.col("n_delete") > F.col("cap"))


def reconcile_drift(mem: DataFrame, view: DataFrame) -> DataFrame:
    """Rows of the canonical view to repair: missing, or disagreeing on the latest key or status."""
    actual = latest_view(mem).select("index_name", "canonical_id", F.col("key").alias("actual_key"), F.col("status").alias("actual_status"))
    held = view.select("index_name", "canonical_id", F.col("key").alias("view_key"), F.col("status").alias("view_status"))
    return actual.join(held, ["index_name", "canonical_id"], "left").where(~F.col("actual_key").eqNullSafe(F.col("view_key")) | ~F.col("actual_status").eqNullSafe(F.col("view_status")))


def sweep_facts(mem: DataFrame, now: int) -> DataFrame:
    """(ts, name, value, unit): what a sweep would report, a fact for each index and count."""
    over = {"PromotedSuperseded": promote_superseded(mem, now), "DeletedArchived": delete_archived(mem, now), "DeletedExpired": delete_expired(mem, now)}
    out = None
    for name, rows in over.items():
        fact = rows.groupBy("index_name").agg(F.countDistinct("key").cast("double").alias("value")).select("index_name", F.lit(now).alias("ts"), F.lit(name).alias("name"), "value", F.lit("Count").alias("unit"))
        out = fact if out is None else out.unionByName(fact.repartition(1))  # so that no two parts share a partitioning
    return out


def sweep(mem: DataFrame, now: int, dry_run: bool = False, cap: int = S.DELETE_CAP, share: float = S.DELETE_CAP_SHARE) -> tuple[DataFrame, dict[str, int]]:
    """One run over a latest-state table: (the state after it, counts). Trips before anything is deleted.

    What is promoted and what goes are found once and written, for the guard, the counts and the result.
    """
    work = Work(mem.sparkSession, "sweep")
    promoted = work.written(promote_superseded(mem, now).select("index_name", "key").distinct())
    over = ((F.col("status") == "archived") & (F.lit(now) - F.col("archived_at") >= S.ARCHIVED_GRACE)) | (F.col("expires_at") <= now)
    doomed = work.written(mem.where(over).select("index_name", "key").distinct())
    tripped = breaker_status(mem, doomed, cap, share).where("tripped").collect()
    if tripped and not dry_run:
        raise CircuitBreaker(", ".join(f"{r['index_name']}: {r['n_delete']} > {r['cap']}" for r in tripped))
    counts = {"archived": promoted.count(), "deleted": doomed.count()}
    if dry_run:
        return mem, counts
    flagged = mem.join(promoted.withColumn("_promote", F.lit(True)), ["index_name", "key"], "left")
    after = flagged.withColumn("archived_at", F.when(F.col("_promote"), F.lit(now)).otherwise(F.col("archived_at"))).withColumn("status", F.when(F.col("_promote"), "archived").otherwise(F.col("status"))).drop("_promote")
    return after.join(doomed, ["index_name", "key"], "left_anti"), counts
