"""Markdown ingestion: front matter, heading chunks, first-paragraph summaries, the ingest plan.

Texts are cut inside their rows, so nothing here shuffles. White space is Unicode's, at every place.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemo import schema as S
from mnemo.functions.text import WHITE, strip


def read_markdown(spark: SparkSession, path: str, excludes: tuple[str, ...] = ()) -> DataFrame:
    """(path, stem, text) of a file, or of every *.md below a folder, but MEMORY.md and excluded names or globs.

    A glob is matched against the path from its end, part by part.
    """
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(path)
    name = F.substring_index(F.col("path"), "/", -1)
    out = files.select(F.input_file_name().alias("path"), F.col("value").alias("text")).withColumn("stem", F.regexp_replace(name, r"\.md$", ""))
    keep = name != "MEMORY.md"
    for glob in excludes:
        parts = ["".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in part) for part in glob.split("/")]
        keep = keep & ~F.col("path").rlike("(^|/)" + "/".join(parts) + "$")
    return out.where(keep)


def plan_histogram(plan: DataFrame, price: float = 0.00002) -> DataFrame:
    """(stem, chunks, tokens, cost) of an ingest plan before anything is stored, by whole tokens of all its chunks."""
    tokens = F.floor(F.sum(F.char_length("content")) / 4)
    out = plan.groupBy("stem").agg(F.count(F.lit(1)).alias("chunks"), tokens.alias("tokens"))
    return out.withColumn("cost", F.round(F.col("tokens") * (price / 1000), 8))


def front_matter(text: Column) -> tuple[Column, Column]:
    """(description, body) of a text that may start with a --- block; quotes around the description go."""
    block = r"(?s)\A---\n(.*?)\n---\n"
    line = F.regexp_extract(F.regexp_extract(text, block, 1), rf"(?mdU)^description:[{WHITE}]*(.+?)[{WHITE}]*$", 1)
    bare = F.regexp_replace(F.regexp_replace(strip(line), '\\A"+|"+\\z', ""), r"\A'+|'+\z", "")
    return F.nullif(bare, F.lit("")), F.regexp_replace(text, block, "")


HEADING = r"#{1,3} +."


def sections(df: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, section, heading, content): a text cut at #, ## and ### headings, blank sections left out.

    Text before the first heading is the (intro), section 0; a text without headings is the (whole file).
    """
    pieces = F.split(strip(F.col(text_col)), rf"(?md)(?=^{HEADING})")
    cut = df.select(id_col, *keep, F.size(pieces).alias("_n"), F.get(pieces, F.lit(0)).rlike(rf"\A{HEADING}").cast("int").alias("_shift"), F.posexplode(pieces).alias("_p", "_piece"))
    headed = F.col("_p") + F.col("_shift") > 0
    heading = F.when(headed, strip(F.regexp_extract("_piece", r"\A#{1,3} +([^\n]+)", 1))).when(F.col("_n") > 1, "(intro)").otherwise("(whole file)")
    return cut.select(id_col, *keep, (F.col("_p") + F.col("_shift")).alias("section"), heading.alias("heading"), strip(F.col("_piece")).alias("content")).where("content <> ''")


def chunk_markdown(df: DataFrame, id_col: str, text_col: str, max_chars: int = S.CHUNK_CHARS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, section, part, heading, content): sections cut every ``max_chars``, later parts marked as continued.

    Columns named in ``keep`` come along.
    """
    parts = F.regexp_extract_all("content", F.lit(f"(?s).{{1,{max_chars}}}"), F.lit(0))
    cut = sections(df, id_col, text_col, keep).select(id_col, *keep, "section", "heading", F.posexplode(parts).alias("part", "content"))
    return cut.withColumn("heading", F.when(F.col("part") > 0, F.concat("heading", F.lit(" (cont. "), F.col("part") + 1, F.lit(")"))).otherwise(F.col("heading")))


def first_paragraph(text: Column, chars: int = S.CHUNK_SUMMARY_CHARS) -> Column:
    """The first paragraph that says something beside heading marks, in one line, cut; else the start of the text."""
    line = lambda p: strip(F.regexp_replace(F.regexp_replace(strip(p), rf"(?U)\A#+[{WHITE}]*", ""), rf"(?U)[{WHITE}]+", " "))
    said = F.filter(F.transform(F.split(strip(text), rf"(?U)\n[{WHITE}]*\n"), line), lambda p: p != "")
    return F.substring(F.coalesce(F.get(said, F.lit(0)), strip(text)), 1, chars)


def ingest_plan(files: DataFrame, max_chars: int = S.CHUNK_CHARS, task_id: str | None = None) -> DataFrame:
    """(path, task_id, section, part, heading, content, summary, tokens) for files (path, stem, text).

    A file is known by its path: files of one stem share a task, not their chunks. ``task_id`` names one
    task for all. A chunk is summed up by its heading, else by the file's description, else by its first paragraph.
    """
    description, body = front_matter(F.col("text"))
    task = F.col("stem") if task_id is None else F.lit(task_id)
    prepared = files.select("path", task.alias("task_id"), description.alias("description"), body.alias("body"))
    chunks = chunk_markdown(prepared, "path", "body", max_chars, ("task_id", "description"))
    named = F.when(~F.col("heading").startswith("("), F.col("heading")).otherwise(F.col("description"))
    summary = F.substring(F.coalesce(F.nullif(named, F.lit("")), first_paragraph(F.col("content"))), 1, S.CHUNK_SUMMARY_CHARS)
    return chunks.withColumn("summary", summary).withColumn("tokens", F.floor(F.char_length("content") / 4)).drop("description")
