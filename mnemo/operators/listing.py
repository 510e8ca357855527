"""Listings of records: by parent, canonical identifier or task, in that precedence, page by page."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemo import schema as S
from mnemo.operators.filters import compile_filter
from mnemo.operators.search import latest_view, top_k
from mnemo.sources import ranges

DAY = 86_400


def by_parent(mem: DataFrame, page_size: int = S.PAGE_SIZE) -> DataFrame:
    """The newest ``page_size`` children of every parent, newest first."""
    order = Window.partitionBy("index_name", "parent_key").orderBy(F.desc("created_at"), "key")
    return mem.where("parent_key IS NOT NULL").withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= page_size)


def by_canonical(mem: DataFrame) -> DataFrame:
    """The record of the latest version of every canonical_id."""
    group = ["index_name", "canonical_id"]
    last = F.max_by("doc_id", F.struct("version", "created_at", "doc_id")).alias("doc_id")  # a key may be shared
    return mem.join(mem.where("canonical_id IS NOT NULL").groupBy(*group).agg(last), [*group, "doc_id"], "left_semi")


def by_task(mem: DataFrame, memory_type: str | None = None, status: str | None = None, page_size: int = S.PAGE_SIZE) -> DataFrame:
    """Latest versions of every task, newest first, in pages; ``next_key`` is where a page's reader goes on, null at the end.

    Rows are ranked within a day of their task and days are counted up, so that a task with a third of
    all rows is no single task's work.
    """
    rows = latest_view(mem).where("task_id IS NOT NULL")
    for column, value in (("memory_type", memory_type), ("status", status)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    group = ["index_name", "task_id"]
    rows = rows.withColumn("_day", F.floor(F.col("created_at") / DAY))
    order = Window.partitionBy(*group, "_day").orderBy(F.desc("created_at"), "key")
    later = Window.partitionBy(*group).orderBy(F.desc("_day"))
    newest = F.min(F.struct((-F.col("created_at")).alias("at"), "key"))["key"]
    days = rows.groupBy(*group, "_day").agg(F.count(F.lit(1)).alias("_rows"), newest.alias("_first"))
    days = days.select(*group, "_day", F.coalesce(F.sum("_rows").over(later.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"), F.lead("_first").over(later).alias("_after"))
    rows = rows.withColumn("_pos", F.row_number().over(order)).withColumn("_next", F.lead("key").over(order)).join(days, [*group, "_day"])
    rows = rows.withColumn("pos", F.col("_pos") + F.col("_base")).withColumn("page", F.floor((F.col("pos") - 1) / page_size))
    return rows.withColumn("next_key", F.when(F.col("pos") % page_size == 0, F.coalesce("_next", "_after"))).drop("_day", "_pos", "_base", "_after", "_next")


def find_index(mem: DataFrame, keys: DataFrame, order: list[str]) -> DataFrame:
    """(key, index_name): the first index, in this order, that holds each asked-for key, null where none does. One join, no probe after probe."""
    asked = keys.select("key").distinct()
    at = F.array_position(F.lit(order), F.col("index_name"))
    return asked.join(mem.select("key", "index_name").where(at > 0), "key", "left").groupBy("key").agg(F.min_by("index_name", at).alias("index_name"))


def lay_by_task(mem: DataFrame, path: str | None = None, file_rows: int = ranges.FILE_ROWS) -> ranges.SortedRows:
    """The latest versions laid out for listing: by index and task, newest first. ``ranges.page`` reads it."""
    rows = latest_view(mem).where("task_id IS NOT NULL")
    return ranges.lay(rows, ["index_name", "task_id"], [("created_at", True), ("key", False)], path, file_rows)


def lay_by_expiry(mem: DataFrame, path: str | None = None, file_rows: int = ranges.FILE_ROWS) -> ranges.SortedRows:
    """Records that expire, by when they do: ``ranges.upto`` finds those that are due."""
    return ranges.lay(mem.where(F.col("expires_at") < S.NO_EXPIRY), [], [("expires_at", False), ("index_name", False), ("key", False)], path, file_rows)


def list_memories(mem: DataFrame, filters: dict, page_size: int = S.PAGE_SIZE, embed: Callable[[str], list[float]] | None = None) -> DataFrame:
    """One page of records by the first of parent_key, canonical_id and task_id that the filters name, else by all of them.

    Only a parent's listing takes further filters of any kind; a task's takes memory_type and status. By
    all of them, records come in the order of their distance from the filters' values, embedded as one
    text; without an embedder in that of doc_id.
    """
    if not 1 <= page_size <= S.PAGE_SIZE:
        raise ValueError(f"page_size must be between 1 and {S.PAGE_SIZE}")
    if "parent_key" in filters:
        return by_parent(mem.where(compile_filter(filters)), page_size)
    if "canonical_id" in filters:
        return by_canonical(mem.where(F.col("canonical_id") == filters["canonical_id"]))
    if "task_id" in filters:
        found = by_task(mem.where(F.col("task_id") == filters["task_id"]), filters.get("memory_type"), filters.get("status"), page_size).where("page = 0")
        return found.select("index_name", "key", "pos").join(mem, ["index_name", "key"])
    if embed is not None:
        return top_k(mem, embed(" ".join(str(v) for v in filters.values()) or " "), page_size, "doc_id", where=compile_filter(filters) if filters else None)
    return mem.where(compile_filter(filters)).orderBy("doc_id").limit(page_size)
