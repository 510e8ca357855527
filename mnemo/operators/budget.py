"""Token budgets: monotone packing as a running sum, and folds where a step depends on the last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemo import schema as S
from mnemo.functions import text as T


def within_budget(df: DataFrame, by: list[str], order: str, max_tokens: int | Column, tokens: str = "tokens", chunk: Column | None = None) -> DataFrame:
    """Rows of each group in order while their tokens fit; the first always does.

    ``chunk`` cuts groups that are no short lists: a number that never falls along ``order``. Sums then
    run within chunks, over which their totals are carried, so that no task holds a whole group.
    """
    parts = [*by, "_chunk"] if chunk is not None else by
    upto = Window.partitionBy(*parts).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = (df if chunk is None else df.withColumn("_chunk", chunk)).withColumn("used_tokens", F.sum(tokens).over(upto)).withColumn("_rn", F.row_number().over(Window.partitionBy(*parts).orderBy(order)))
    if chunk is not None:
        before = Window.partitionBy(*[f"_g{k}" for k in range(len(by))]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        totals = df.groupBy(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(by)], chunk.alias("_part")).agg(F.sum(tokens).alias("_sum"), F.count(F.lit(1)).alias("_rows"))
        totals = totals.withColumn("_sum", F.coalesce(F.sum("_sum").over(before), F.lit(0))).withColumn("_rows", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        same = F.col("_chunk").eqNullSafe(F.col("_part"))
        for k, c in enumerate(by):
            same = same & F.col(c).eqNullSafe(F.col(f"_g{k}"))
        numbered = numbered.join(totals, same).withColumn("used_tokens", F.col("used_tokens") + F.col("_sum")).withColumn("_rn", F.col("_rn") + F.col("_rows"))
        numbered = numbered.drop("_chunk", "_part", "_sum", "_rows", *[f"_g{k}" for k in range(len(by))])
    return numbered.where((F.col("_rn") == 1) | (F.col("used_tokens") <= max_tokens)).drop("_rn")


def with_substitution(df: DataFrame, by: list[str], order: str, max_tokens: int, full: str = "full_tokens", short: str = "summary_tokens") -> DataFrame:
    """In order: the body, or the summary where there is one and the body is over what is left; stop at what fits neither.

    The first row is always admitted, by its summary too if its body is over the budget. ``full`` is the
    cost of what a row would show, ``short`` of its summary (null: none). A fold over the group's
    ordered list (at most the top-k rows of a query), inside the JVM.
    """
    items = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).cast("int").alias("o"), F.col(full).cast("long").alias("f"), F.col(short).cast("long").alias("s")))).alias("items"))

    def step(acc: Column, x: Column) -> Column:
        swap = (acc["used"] + x["f"] > max_tokens) & x["s"].isNotNull()
        cost = F.when(swap, x["s"]).otherwise(x["f"])
        take = ~acc["stop"] & ((F.size(acc["out"]) == 0) | (acc["used"] + cost <= max_tokens))
        row = F.struct(x["o"].alias("o"), F.when(swap, F.lit("summary")).otherwise(F.lit("full")).alias("detail"), cost.alias("tokens"))
        return F.struct(
            (acc["used"] + F.when(take, cost).otherwise(F.lit(0).cast("long"))).alias("used"), (acc["stop"] | ~take).alias("stop"),
            F.when(take, F.concat(acc["out"], F.array(row))).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(False).alias("stop"), F.expr("cast(array() as array<struct<o:int,detail:string,tokens:bigint>>)").alias("out"))
    folded = items.select(*by, F.explode(F.aggregate("items", start, step, lambda a: a["out"])).alias("r"))
    return folded.select(*by, F.col("r.o").alias(order), F.col("r.detail").alias("detail"), F.col("r.tokens").alias("tokens"))


LEVELS = ("summary", "standard", "full")


def at_level(df: DataFrame, by: list[str], order: str, level: str, max_tokens: int) -> DataFrame:
    """Ranked rows (content, content_summary) at a detail level, to budget: adds detail, tokens and used_tokens.

    ``summary``: previews only. ``standard``: bodies for the first two, summaries after. ``full``: bodies.
    A body that is over what is left gives way to its summary.
    """
    if level not in LEVELS:
        raise ValueError(f"detail_level must be one of {', '.join(LEVELS)}; got {level!r}")
    preview = T.estimate_tokens(T.preview(F.col("content_summary"), F.col("content")))
    if level == "summary":
        return within_budget(df.withColumn("detail", F.lit("summary")).withColumn("tokens", preview), by, order, max_tokens)
    body, summary = T.estimate_tokens(F.col("content")), F.when(F.col("content_summary").isNotNull(), T.estimate_tokens(F.col("content_summary")))
    whole = F.col("content").isNotNull() & ((F.col(order) <= 2) if level == "standard" else F.lit(True))
    sized = df.withColumn("_whole", whole).withColumn("full_tokens", F.when(whole, body).otherwise(F.coalesce(summary, F.lit(0)))).withColumn("summary_tokens", F.when(whole, summary))
    taken = with_substitution(sized, by, order, max_tokens)
    out = sized.withColumn(order, F.col(order).cast("int")).join(taken, [*by, order]).withColumn("detail", F.when(F.col("_whole"), F.col("detail")).otherwise("summary"))
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return out.drop("_whole", "full_tokens", "summary_tokens").withColumn("used_tokens", F.sum("tokens").over(upto))


def hydrate_upgrade(df: DataFrame, by: list[str], order: str, max_tokens: int, wanted: str = "wanted_pos", most: int = S.HYDRATE_MAX) -> DataFrame:
    """Swap previews for bodies, in the caller's key order, skipping those that do not fit.

    ``wanted`` is the key's place in the caller's list (null: not asked for), of which the first
    ``most`` count. ``tokens`` is the preview's cost and is still counted while its body is tried.
    """
    listed = df.groupBy(*by).agg(
        F.sum("tokens").alias("used0"),
        F.array_sort(F.collect_list(F.when((F.col(wanted) <= most), F.struct(F.col(wanted).cast("int").alias("w"), F.col(order).cast("int").alias("o"), F.col("tokens").cast("long").alias("t"), F.col("full_tokens").cast("long").alias("f"))))).alias("items"),
    )

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["f"] <= max_tokens
        return F.struct(F.when(fits, acc["used"] - x["t"] + x["f"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["out"], F.array(x["o"]))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.col("used0").cast("long").alias("used"), F.expr("cast(array() as array<int>)").alias("out"))
    done = listed.select(*by, F.aggregate("items", start, step, lambda a: a["out"]).alias("_up"))
    return df.join(done, by).withColumn("hydrated", F.array_contains("_up", F.col(order).cast("int"))).withColumn("tokens", F.when(F.col("hydrated"), F.col("full_tokens")).otherwise(F.col("tokens"))).drop("_up")
