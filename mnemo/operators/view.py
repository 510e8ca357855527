"""The canonical view as a stored table that is kept up from changes, never computed anew.

A change touches the canonical identifiers of the records that it wrote or deleted. Only their
buckets of the records are read, only their rows of the view are written; a deleted latest version
gives its place to the runner-up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemo.operators.search import latest_view
from mnemo.sources.stored import StoredTable

GROUP = ["index_name", "canonical_id"]
RECORD = "index_name string, canonical_id string, key string, doc_id long, version int, task_id string, agent_id string, memory_type string, status string, created_at long"
VIEW = "index_name string, canonical_id string, key string, version int, task_id string, agent_id string, memory_type string, status string, created_at long, n_versions long"


def create(spark: SparkSession, path: str, buckets: int = 64, keys: Sequence[str] = ("index_name", "key")) -> tuple[StoredTable, StoredTable]:
    """(records, view): empty tables that lie in buckets by canonical identifier both. ``keys`` tell records apart."""
    return (
        StoredTable.create(spark, f"{path}/records", RECORD, keys, GROUP, buckets),
        StoredTable.create(spark, f"{path}/view", VIEW, GROUP, GROUP, buckets),
    )


def _follow(records: StoredTable, view: StoredTable, changed: DataFrame) -> None:
    groups = changed.where("canonical_id IS NOT NULL").select(*GROUP).distinct()
    touched = records.buckets_of(groups)
    if not touched:
        return
    fresh = latest_view(records.read(buckets=touched).join(groups, GROUP, "left_semi"))
    view.upsert(fresh)
    empty = groups.join(fresh.select(*GROUP), GROUP, "left_anti")
    if not empty.isEmpty():
        view.delete(empty)


def upsert(records: StoredTable, view: StoredTable, rows: DataFrame) -> None:
    """Write records and bring the view after them. A record keeps its canonical identifier."""
    records.upsert(rows)
    _follow(records, view, rows)


def delete(records: StoredTable, view: StoredTable, keys: DataFrame) -> None:
    """Delete records by their keys and canonical_id and bring the view after them."""
    records.delete(keys)
    _follow(records, view, keys)


def drift(records: StoredTable, view: StoredTable) -> DataFrame:
    """Rows of the view that are missing, left over or differ from one made of all records: none, unless a writer died between its two commits."""
    actual, held = latest_view(records.read()), view.read()
    pairs = actual.select(*GROUP, F.struct("key", "version", "status", "n_versions").alias("actual")).join(held.select(*GROUP, F.struct("key", "version", "status", "n_versions").alias("held")), GROUP, "full")
    return pairs.where(~F.col("actual").eqNullSafe(F.col("held")))


def repair(records: StoredTable, view: StoredTable) -> int:
    """Bring the drifted rows of the view right; returns how many there were."""
    off = drift(records, view)
    n = off.count()
    if n:
        _follow(records, view, off)
    return n
