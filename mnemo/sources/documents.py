"""JSON sources and sinks: settings, golden questions, record rows."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _flat(tree: Mapping, root: str) -> dict[str, str]:
    """Values of a parameter tree: nested objects, or names that are paths below ``root``, to names in one piece."""
    out: dict[str, str] = {}
    for name, value in tree.items():
        name = name.removeprefix(root).strip("/").replace("/", "_").replace("-", "_")
        if isinstance(value, Mapping):
            out |= {f"{name}_{k}".lstrip("_"): v for k, v in _flat(value, root).items()}
        else:
            out[name] = value if isinstance(value, str) else json.dumps(value)
    return out


def settings(text: str, required: tuple[str, ...], prefix: str = "MNEMO_", env: Mapping[str, str] = os.environ, root: str = "/mnemo", defaults: Mapping[str, str] | None = None) -> dict[str, str]:
    """Settings of a JSON parameter tree, environment variables before it and defaults after it.

    A value's name is its path: {"index": {"shared-name": "x"}} and {"/mnemo/index/shared-name": "x"} are both
    index_shared_name. Missing required ones are an error that lists them all; values that are no text stay JSON.
    """
    found = dict(defaults or {}) | _flat(json.loads(text), root)
    found |= {k[len(prefix) :].lower(): v for k, v in env.items() if k.startswith(prefix)}
    missing = sorted(k for k in required if not found.get(k))
    if missing:
        raise ValueError("missing settings: " + ", ".join(missing))
    return found


GOLDEN = "questions array<struct<id:string,query:string,filters:map<string,string>,expected_task_ids:array<string>,downstream:struct<answer_task_id:string>>>"


def golden_set(spark: SparkSession, path: str) -> DataFrame:
    """(id, query, filters, expected, answer_task_id) of a JSON file of questions."""
    rows = spark.read.schema(GOLDEN).json(path, multiLine=True).select(F.explode("questions").alias("q"))
    return rows.select("q.id", "q.query", "q.filters", F.col("q.expected_task_ids").alias("expected"), F.col("q.downstream.answer_task_id").alias("answer_task_id"))


def record_view(mem: DataFrame) -> DataFrame:
    """Records as readers get them, with defaults for what is absent."""
    texts = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("agent_id", "team_id", "task_id", "canonical_id", "memory_type", "status", "origin")]
    return mem.select("key", *texts, F.coalesce("version", F.lit(1)).alias("version"), F.coalesce("created_at", F.lit(0)).alias("created_at"), "content_hash", "expires_at", "confidence")


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON object a row, nulls included."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
