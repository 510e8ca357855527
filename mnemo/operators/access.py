"""Requests answered as rows: rights of roles, errors as data, and health checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemo import schema as S
from mnemo.operators.search import latest_view, live

def rights() -> Column:
    """What every role may do: an array of (role, verb)."""
    found = [(role, verb) for role in S.ROLE_INDEXES for verb in (*S.READ_ONLY_VERBS, *(() if role in S.READ_ONLY_ROLES else S.WRITE_VERBS))]
    return F.array(*[F.struct(F.lit(r).alias("role"), F.lit(v).alias("verb")) for r, v in found])


def _map(pairs: dict[str, tuple[str, ...]]) -> Column:
    return F.create_map(*[x for role, values in pairs.items() for x in (F.lit(role), F.lit(list(values)))])


def whoami(requests: DataFrame) -> DataFrame:
    """Adds ``default_index`` and ``allowed_indexes`` of a request's role; an unknown role has neither."""
    allowed = F.try_element_at(_map(S.ROLE_INDEXES), F.col("role"))
    return requests.withColumn("allowed_indexes", allowed).withColumn("default_index", F.get(allowed, F.lit(0)))


def dispatch(requests: DataFrame, mem: DataFrame) -> DataFrame:
    """Requests (request_id, agent_id, role, verb, index_name, key) answered one by one, errors as data.

    A request fails for the first of: a role that doesn't exist, a verb its role doesn't have, an index
    its role may not use, a key that isn't in the index. ``index_name`` null is the role's default. Every
    answer carries ``agent_id`` and ``role``. ``available`` and ``allowed`` say what would have done.
    """
    verbs = {role: tuple(sorted({*S.READ_ONLY_VERBS, *(() if role in S.READ_ONLY_ROLES else S.WRITE_VERBS)})) for role in S.ROLE_INDEXES}
    asked = whoami(requests).withColumn("_verbs", F.try_element_at(_map(verbs), F.col("role"))).withColumn("index_name", F.coalesce("index_name", "default_index"))
    found = mem.select("index_name", "key", "status", "version", F.lit(True).alias("_found"))
    rows = asked.join(found, ["index_name", "key"], "left")
    bad_role, bad_verb = F.col("allowed_indexes").isNull(), ~F.coalesce(F.array_contains("_verbs", F.col("verb")), F.lit(False))
    bad_index = ~F.coalesce(F.array_contains("allowed_indexes", F.col("index_name")), F.lit(False))
    missing = F.col("key").isNotNull() & F.col("_found").isNull()
    error = (
        F.when(bad_role, F.concat(F.lit("unknown role: "), F.coalesce("role", F.lit("")))).when(bad_verb, F.concat(F.lit("unknown verb: "), F.coalesce("verb", F.lit(""))))
        .when(bad_index, F.concat(F.lit("index not permitted for this role: "), "index_name")).when(missing, F.concat(F.lit("key not found: "), "key"))
    )
    kind = F.when(bad_role, "role").when(bad_verb, "verb").when(bad_index, "index").when(missing, "key")
    ok = error.isNull()
    return rows.select(
        "request_id", "agent_id", "role", "verb", "index_name", "key", error.alias("error"), kind.alias("error_type"),
        F.when(~bad_role & bad_verb, F.col("_verbs")).alias("available"), F.when(~bad_role & ~bad_verb & bad_index, F.col("allowed_indexes")).alias("allowed"),
        F.when(ok, F.col("status")).alias("status"), F.when(ok, F.col("version")).alias("version"),
    )


def health(mem: DataFrame, view: DataFrame, now: int, role: str = "auditor") -> DataFrame:
    """(check, status, n, detail): the state of a store as rows, read-only.

    ``role`` must be known; records must have vectors, an identifier and bodies where no summary stands
    in; chunks must have parents; the view must agree with the records. What the checks count comes from
    one pass over the records, and one join with the view.
    """
    fails = lambda condition: F.count_if(F.coalesce(condition, F.lit(False)))
    counts = mem.agg(
        F.count(F.lit(1)).alias("records"), fails(F.col("embedding").isNull()).alias("vectors"), fails(F.coalesce(F.col("canonical_id"), F.lit("")) == "").alias("identifiers"),
        fails((F.col("memory_type") == "chunk") & F.col("parent_key").isNull()).alias("parents"), fails((F.col("status") == "active") & (F.col("expires_at") <= now)).alias("expiry"),
    )
    actual = latest_view(mem).select("index_name", "canonical_id", F.col("key").alias("_actual"))
    drift = actual.join(view.select("index_name", "canonical_id", F.col("key").alias("_held")), ["index_name", "canonical_id"], "full").where(~F.col("_actual").eqNullSafe(F.col("_held"))).agg(F.count(F.lit(1)).alias("drift"))
    known = role in S.ROLE_INDEXES
    row = counts.withColumn("_", F.lit(1)).join(drift.withColumn("_", F.lit(1)), "_")  # one row each
    check = lambda name, n, bad, hint: F.struct(F.lit(name).alias("check"), F.when(n == 0, "pass").otherwise(bad).alias("status"), n.cast("long").alias("n"), F.when(n > 0, hint).alias("detail"))
    rows = [
        F.struct(F.lit("role").alias("check"), F.lit("pass" if known else "fail").alias("status"), F.lit(0 if known else 1).cast("long").alias("n"), F.lit(None if known else "choose one of: " + ", ".join(sorted(S.ROLE_INDEXES))).cast("string").alias("detail")),
        F.struct(F.lit("records").alias("check"), F.when(F.col("records") > 0, "pass").otherwise("warn").alias("status"), F.col("records").alias("n"), F.when(F.col("records") == 0, "nothing is stored").alias("detail")),
        check("vectors", F.col("vectors"), "fail", "records without a vector are never found"), check("identifiers", F.col("identifiers"), "fail", "records without canonical_id are in no view"),
        check("parents", F.col("parents"), "warn", "chunks without a parent are dropped from results"), check("expiry", F.col("expiry"), "warn", "run the sweep"), check("view", F.col("drift"), "fail", "repair the view"),
    ]
    return row.select(F.explode(F.array(*rows)).alias("c")).select("c.*")


def reachable(mem: DataFrame, now: int) -> DataFrame:
    """(role, verb, n): how many live records each right reaches."""
    sizes = live(mem, now).groupBy("index_name").agg(F.count(F.lit(1)).alias("n"))
    rows = sizes.select("index_name", "n", F.explode(rights()).alias("r")).select("index_name", "n", "r.*")
    return rows.where(F.array_contains(F.try_element_at(_map(S.ROLE_INDEXES), F.col("role")), F.col("index_name"))).groupBy("role", "verb").agg(F.sum("n").alias("n"))
