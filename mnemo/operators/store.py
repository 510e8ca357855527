"""Writes as an append-only log of record states: validation, replacement, archiving, restoring, purging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemo import schema as S
from mnemo.functions import text as T


def current_state(log: DataFrame, by: Sequence[str] = ("index_name", "key")) -> DataFrame:
    """The latest state of each record, told apart by ``by``, by op_seq; deleted ones are gone. Aggregation only."""
    payload = [c for c in log.columns if c not in by]
    last = log.groupBy(*by).agg(F.max_by(F.struct(*payload), "op_seq").alias("r"))
    out = last.select(*by, "r.*")
    return out.where("NOT coalesce(deleted, false)") if "deleted" in payload else out


def route_content(df: DataFrame, limit: int = S.INLINE_MAX_BYTES) -> DataFrame:
    """Bodies over the limit go to the content table under a derived path; others stay inline."""
    big = F.octet_length("content") > limit
    return df.withColumn("content_ref", F.when(big, F.concat("index_name", F.lit("/"), "key", F.lit(".json")))).withColumn("inline_content", F.when(~big, F.col("content")))


def resolve_content(df: DataFrame, contents: DataFrame) -> DataFrame:
    stored = contents.select("index_name", "key", F.col("content").alias("_body"))
    return df.join(stored, ["index_name", "key"], "left").withColumn("content", F.coalesce("inline_content", "_body")).drop("_body")


def _ascii_json_bytes(text: Column) -> Column:
    """Bytes of a JSON string in ASCII: six for each escaped character, twelve beyond the BMP."""
    plain = F.regexp_replace(text, r"[\x{10000}-\x{10FFFF}]", "aaaaaaaaaaaa")
    return F.char_length(F.regexp_replace(plain, r"[^\x00-\x7F]", "aaaaaa"))


def validate(df: DataFrame) -> DataFrame:
    """Adds ``problem``: the first rule a record breaks, null if none."""
    ids_ok = [F.coalesce((F.trim(c) != "") & (F.char_length(c) <= S.ID_CHARS), F.lit(False)) for c in ("agent_id", "team_id", "task_id")]
    filterable = F.to_json(F.struct(*[c for c in S.FILTERABLE if c in df.columns]))
    return df.withColumn(
        "problem",
        F.when(~(ids_ok[0] & ids_ok[1] & ids_ok[2]), "bad identifier")
        .when(~F.col("memory_type").isin(*S.MEMORY_TYPES), "bad memory_type")
        .when((F.col("memory_type") == "chunk") & F.col("parent_key").isNull(), "chunk without parent")
        .when(F.size("linked_ids") > S.LINKED_MAX, "too many links")
        .when(T.summary_required(F.col("content")) & (F.coalesce(F.trim("content_summary"), F.lit("")) == ""), "summary required")
        .when(_ascii_json_bytes(filterable) > S.FILTERABLE_BYTES, "metadata too large"),
    )


def screen(df: DataFrame) -> DataFrame:
    """Adds ``suspect``: text of external origin that reads like instructions. Such writes go on; they are counted."""
    return df.withColumn("suspect", (F.col("origin") == "external") & T.injection_suspect(F.col("content")))


def mark_chunks(df: DataFrame, mem: DataFrame) -> DataFrame:
    """Chunks with ``valid``: their parent is a document of the same index."""
    parents = mem.where("memory_type = 'document'").select("index_name", F.col("key").alias("parent_key"), F.lit(True).alias("_there")).distinct()
    marked = df.where("memory_type = 'chunk'").join(parents, ["index_name", "parent_key"], "left")
    return marked.withColumn("valid", F.coalesce("_there", F.lit(False))).drop("_there")


def chunk_parents(df: DataFrame, mem: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) chunks."""
    marked = mark_chunks(df, mem)
    return marked.where("valid").drop("valid"), marked.where("NOT valid").drop("valid")


def outcome_facts(classified: DataFrame, at: str) -> DataFrame:
    """Metric facts (ts, name, value, unit) of a batch's outcomes, as an emitter would append them."""
    name = F.concat(F.lit("Store"), F.replace(F.initcap(F.replace("action", F.lit("_"), F.lit(" "))), F.lit(" "), F.lit("")))
    return classified.select(F.col(at).alias("ts"), name.alias("name"), F.lit(1.0).alias("value"), F.lit("Count").alias("unit"))


def get(mem: DataFrame, contents: DataFrame, keys: DataFrame) -> DataFrame:
    """One row for each asked-for (index_name, key): the record with its whole body, or nulls where there is none.

    Bodies that are kept outside come from the path derived from the key, never from a stored one.
    """
    found = resolve_content(mem.join(keys, ["index_name", "key"], "left_semi"), contents)
    return keys.distinct().join(found, ["index_name", "key"], "left").withColumn("hydrated", F.col("content").isNotNull())


def reinforce(mem: DataFrame, keys: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(use events to append, keys that do not exist) for asked-for (index_name, key)."""
    events = mem.select("index_name", "key", "canonical_id").join(keys, ["index_name", "key"]).where("canonical_id IS NOT NULL").select("key", "canonical_id", F.lit(now).alias("ts"))
    return events, keys.join(mem.select("index_name", "key"), ["index_name", "key"], "left_anti")


def supersede(classified: DataFrame, mem: DataFrame, now: int) -> DataFrame:
    """New record states for superseding rows and their targets: version + 1, same canonical and links."""
    old = mem.select("index_name", F.col("key").alias("supersedes_key"), F.col("version").alias("_version"), F.col("canonical_id").alias("_canonical"), F.col("linked_ids").alias("_links"))
    rows = classified.where("action = 'superseded'").join(old, ["index_name", "supersedes_key"])
    version = F.col("_version") + 1
    new = rows.select(
        "index_name", T.vector_key(F.col("agent_id"), F.col("task_id"), F.substring_index("content_hash", ":", -1), version).alias("key"), version.alias("version"), F.col("_canonical").alias("canonical_id"),
        F.coalesce(F.when(F.size("linked_ids") > 0, F.col("linked_ids")), F.col("_links")).alias("linked_ids"), F.lit("active").alias("status"), F.lit(now).alias("created_at"), F.col("supersedes_key").alias("supersedes"),
    )
    retired = mem.join(rows.select("index_name", F.col("supersedes_key").alias("key")).distinct(), ["index_name", "key"], "left_semi").select(
        "index_name", "key", "version", "canonical_id", "linked_ids", F.lit("superseded").alias("status"), "created_at", "supersedes"
    )
    return new.unionByName(retired)


def archived_state(now: int) -> tuple[Column, Column]:
    """(status, archived_at) of a record once it is archived; archived ones keep their time."""
    return F.lit("archived"), F.when(F.col("status") == "archived", F.col("archived_at")).otherwise(F.lit(now))


def archive(mem: DataFrame, keys: DataFrame, now: int) -> DataFrame:
    """States of the asked-for records after archiving. Records are named by all columns of ``keys``: a key that several share needs more."""
    status, archived_at = archived_state(now)
    return mem.join(keys, keys.columns, "left_semi").withColumn("archived_at", archived_at).withColumn("status", status)


def restore(mem: DataFrame, keys: DataFrame, now: int) -> DataFrame:
    """A new latest version of each record's canonical_id with the asked-for record's body."""
    latest = mem.groupBy("index_name", "canonical_id").agg(F.max("version").alias("_top"), F.max_by("key", F.struct("version", "created_at", "doc_id")).alias("supersedes_latest"))
    rows = mem.join(keys, ["index_name", "key"], "left_semi").join(latest, ["index_name", "canonical_id"])
    digest = F.substring_index("content_hash", ":", -1)
    return rows.select("index_name", "canonical_id", F.col("key").alias("restored_from"), "supersedes_latest", (F.col("_top") + 1).alias("version"), T.vector_key(F.col("agent_id"), F.col("task_id"), digest, F.col("_top") + 1).alias("key"), "content", F.lit("active").alias("status"), F.lit(now).alias("created_at"))


def purge(mem: DataFrame, canonical_ids: DataFrame) -> DataFrame:
    """What remains after every version of the given canonical_ids is gone."""
    return mem.join(canonical_ids, ["index_name", "canonical_id"], "left_anti")


def purge_all(mem: DataFrame, contents: DataFrame, view: DataFrame, canonical_ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(records, bodies kept outside, canonical rows, purged keys) once whole canonical groups are deleted everywhere.

    Bodies go by the keys of the records that go, and by their doc_id where bodies name it, as keys may be shared;
    ``purged keys`` has a row for each record, the latest first by ``pos``.
    Identifiers that nothing is stored under still lose their canonical row.
    """
    gone = mem.join(canonical_ids.distinct(), ["index_name", "canonical_id"], "left_semi")
    by = [c for c in ("index_name", "key", "doc_id") if c in contents.columns]
    keys = gone.select(*by).distinct()
    order = Window.partitionBy("index_name", "canonical_id").orderBy(F.desc("version"), F.desc("created_at"), "key")
    listed = gone.select("index_name", "canonical_id", "key", (F.row_number().over(order) - 1).alias("pos"))
    return purge(mem, canonical_ids), contents.join(keys, by, "left_anti"), view.join(canonical_ids, ["index_name", "canonical_id"], "left_anti"), listed


def usage_counters(events: DataFrame) -> DataFrame:
    """(canonical_id, use_count, last_used_at) from appended use events (canonical_id, ts as epoch seconds)."""
    return events.groupBy("canonical_id").agg(F.count(F.lit(1)).alias("use_count"), F.max("ts").alias("last_used_at"))
