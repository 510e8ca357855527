"""The map of memories: principal components, cluster statistics, self-contained export."""

from __future__ import annotations

import json

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pca(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 2) -> DataFrame:
    """(id, c1..ck) in [-1, 1]: centred principal components, each sign set so its largest loading is positive."""
    dense = df.where(F.col(vector_col).isNotNull()).select(id_col, array_to_vector(F.col(vector_col).cast("array<double>")).alias("v"))
    model = PCA(k=k, inputCol="v", outputCol="p").fit(dense)
    loadings = np.array(model.pc.toArray())
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(k)])
    points = model.transform(dense).withColumn("p", vector_to_array("p"))
    raw = points.select(id_col, *[(F.col("p")[i] * float(signs[i])).alias(f"_c{i + 1}") for i in range(k)])
    spans = raw.agg(*[f(f"_c{i + 1}").alias(f"{n}{i}") for i in range(k) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    def scaled(i: int):
        lo, hi = spans[f"lo{i}"], spans[f"hi{i}"]
        return F.lit(0.0) if lo is None or hi == lo else (F.col(f"_c{i + 1}") - lo) / (hi - lo) * 2 - 1
    return raw.select(id_col, *[F.round(scaled(i), 4).alias(f"c{i + 1}") for i in range(k)])


def constellations(points: DataFrame, least: int = 3, smallest: float = 0.08) -> DataFrame:
    """Per task with at least ``least`` points (task_id, x, y): count, centroid, spread. Two aggregations."""
    centres = points.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy")).where(F.col("n") >= least)
    away = points.join(centres, "task_id").groupBy("task_id", "n", "cx", "cy").agg(F.max(F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))).alias("far"))
    return away.select("task_id", "n", "cx", "cy", F.greatest(F.lit(smallest), F.col("far")).alias("spread"))


def kind_counts(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(kind, name, n) by several columns at once: rows are read and dealt out once."""
    named = F.array(*[F.struct(F.lit(kind).alias("kind"), F.coalesce(F.col(column), F.lit("?")).alias("name")) for kind, column in kinds.items()])
    return df.select(F.explode(named).alias("g")).groupBy("g.kind", "g.name").agg(F.count(F.lit(1)).alias("n"))


def group_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column), F.lit("?")).alias(column)).agg(F.count(F.lit(1)).alias("n"))


def points_view(mem: DataFrame, coords: DataFrame, chars: int = 280) -> DataFrame:
    """Flat rows for the map: coordinates, labels, the text cut to ``chars`` and the rest where it is longer."""
    text = F.coalesce("content_summary", "content", F.lit(""))
    return mem.join(coords, "doc_id").select("key", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), *[F.coalesce(F.col(c), F.lit("?")).alias(c) for c in ("agent_id", "team_id", "task_id", "memory_type", "status")], "version", F.col("created_at").alias("created"), F.substring(text, 1, chars).alias("text"), F.when(F.char_length(text) > chars, text).alias("full"))


def export_html(points: DataFrame, template: str, limit: int = 50_000) -> str:
    """One page with the points inside it; a page is for people, so more than ``limit`` points is an error."""
    rows = [r.asDict() for r in points.limit(limit + 1).collect()]
    if len(rows) > limit:
        raise ValueError(f"over {limit} points: aggregate or filter before exporting a page")
    return template.replace("/*POINTS*/", json.dumps(rows).replace("</", "<\\/"))


def service_hits(raw: DataFrame, chars: int = 280) -> DataFrame:
    """Hits of a search service (key, distance, score, text, content_summary, type, memory_type, task, team, in_galaxy) in our own names."""
    first = lambda *c: F.coalesce(*[F.nullif(F.col(x), F.lit("")) for x in c])
    return raw.select(
        "key", "distance", "score", F.substring(first("text", "content_summary"), 1, chars).alias("content_summary"), first("type", "memory_type").alias("memory_type"),
        F.col("task").alias("task_id"), F.col("team").alias("team_id"), "in_galaxy", F.lit(False).alias("hydrated"),
    )


def lexical_filter(df: DataFrame, query: str, hidden_agents: list[str] | None = None) -> DataFrame:
    text = F.lower(F.concat_ws(" ", F.coalesce("content_summary", "content"), "task_id", "key"))
    out = df.where(text.contains(query.lower()))
    return out.where(~F.col("agent_id").isin(hidden_agents)) if hidden_agents else out


def ordered_points(points: DataFrame) -> DataFrame:
    """Members of each task in order of creation, numbered."""
    return points.withColumn("n", F.row_number().over(Window.partitionBy("task_id").orderBy("created", "key")))
