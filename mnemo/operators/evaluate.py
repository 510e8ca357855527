"""Retrieval quality: recall, token savings, gates and rubric scores over runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.functions import text as T


def recall(runs: DataFrame, expected: str = "expected", got: str = "got") -> DataFrame:
    """Adds ``recall``: share of the expected identifiers among those retrieved; 0 where none are expected."""
    return runs.withColumn("recall", F.coalesce(F.try_divide(F.size(F.array_intersect(F.array_distinct(got), F.array_distinct(expected))).cast("double"), F.size(F.array_distinct(expected))), F.lit(0.0)))


def summarise_arm(runs: DataFrame, by: list[str]) -> DataFrame:
    """Runs (recall, tokens, stale, answered, hydrations, hydration_tokens, latency_ms) by arm: means, sums, spread."""
    return runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"), F.avg("recall").alias("mean_recall"), F.min("recall").alias("min_recall"), F.stddev_pop("recall").alias("sd_recall"),
        F.sum("tokens").alias("tokens"), F.sum("stale").alias("stale"), F.avg(F.col("answered").cast("double")).alias("answer_rate"), F.sum("hydrations").alias("hydrations"),
        F.sum("hydration_tokens").alias("hydration_tokens"), F.sum(F.col("tokens") + F.col("hydration_tokens")).alias("net_tokens"), F.avg("latency_ms").alias("mean_latency_ms"),
    )


def run_deviation(runs: DataFrame, by: list[str], question: str = "query_id") -> DataFrame:
    """The largest deviation of recall between repeats of one question, by arm."""
    return runs.groupBy(*by, question).agg(F.stddev_pop("recall").alias("sd")).groupBy(*by).agg(F.max("sd").alias("max_run_sd"))


def gate(summary: DataFrame, deviation: DataFrame, control: str, candidate: str) -> DataFrame:
    """One row of the seven checks of the candidate arm against control, and whether all pass."""
    held = ("mean_recall", "stale", "answer_rate", "hydrations", "net_tokens", "max_run_sd")
    row = summary.join(deviation, "arm").groupBy().pivot("arm", [control, candidate]).agg(*[F.first(m).alias(m) for m in held])
    c, d = (lambda m: F.col(f"{control}_{m}")), (lambda m: F.col(f"{candidate}_{m}"))
    checks = {
        "answers_hold": d("answer_rate") >= c("answer_rate"), "recall_floor": d("mean_recall") >= 0.90, "recall_holds": d("mean_recall") >= c("mean_recall"), "none_stale": d("stale") == 0,
        "hydrations_hold": d("hydrations") <= c("hydrations"), "fewer_tokens": d("net_tokens") < c("net_tokens"), "stable": d("max_run_sd") <= 1e-9,
    }
    out = row.select(*[v.alias(k) for k, v in checks.items()])
    every = F.lit(True)
    for k in checks:
        every = every & F.col(k)
    return out.withColumn("passed", every)


def score_answers(answers: DataFrame, groups: list[list[str]], control: str) -> DataFrame:
    """Answers (task_id, budget, arm, answer, packed_tokens) scored by a rubric, with savings against the control arm's cell."""
    base = answers.where(F.col("arm") == control).groupBy("task_id").agg(F.max("packed_tokens").alias("_control"))
    scored = answers.join(base, "task_id", "left").withColumn("correct", T.rubric_match(F.col("answer"), groups))
    scored = scored.withColumn("insufficient", F.upper(F.trim("answer")).startswith("INSUFFICIENT CONTEXT"))
    saved = F.when(F.coalesce("_control", F.lit(0)) > 0, F.round(100.0 * (F.col("_control") - F.col("packed_tokens")) / F.col("_control"), 1)).otherwise(F.lit(0.0))
    return scored.withColumn("savings_pct", saved).drop("_control")


def accuracy_by_budget(scored: DataFrame) -> DataFrame:
    return scored.groupBy("budget").agg(
        F.min("arm").alias("arm"), F.count_if("correct").alias("correct"), F.count(F.lit(1)).alias("answers"), F.count_if("insufficient").alias("insufficient"), F.round(F.avg("savings_pct"), 1).alias("mean_savings_pct")
    )


def accuracy_by_arm(scored: DataFrame) -> DataFrame:
    """Per arm: answers, how many are right and how many say they lack context, what was packed for them and what that saves."""
    return scored.groupBy("arm").agg(
        F.count(F.lit(1)).alias("answers"), F.count_if("correct").alias("correct"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy"), F.count_if("insufficient").alias("insufficient"),
        F.sum("packed_tokens").alias("packed_tokens"), F.round(F.avg("savings_pct"), 1).alias("mean_savings_pct"),
    )


def budget_sweep(kept: DataFrame, control: DataFrame) -> DataFrame:
    """Per budget: mean savings %, top-1 survival and recall of control's keys. Rows: (budget, query_id, rank, key, tokens)."""
    base = control.groupBy("query_id").agg(F.sum("tokens").alias("all_tokens"), F.count(F.lit(1)).alias("all_keys"), F.min_by("key", "rank").alias("top"))
    shared = kept.join(control.select("query_id", "key"), ["query_id", "key"], "left_semi").groupBy("budget", "query_id").agg(F.count(F.lit(1)).alias("shared"))
    arms = kept.groupBy("budget", "query_id").agg(F.sum("tokens").alias("tokens"), F.min_by("key", "rank").alias("first"))
    per = arms.join(base, "query_id").join(shared, ["budget", "query_id"], "left")
    return per.groupBy("budget").agg(
        F.round(F.avg(F.try_divide(100.0 * (F.col("all_tokens") - F.col("tokens")), F.col("all_tokens"))), 1).alias("savings_pct"),
        F.sum((F.col("first") == F.col("top")).cast("int")).alias("top1"), F.count(F.lit(1)).alias("queries"), F.round(F.avg(F.coalesce("shared", F.lit(0)) / F.col("all_keys")), 3).alias("recall"),
    )
