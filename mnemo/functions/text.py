"""Column functions over text: identity, previews, sizes, citations, screens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemo import schema as S

# Instruction-like phrases, screened in text of external origin.
INJECTION_PATTERNS = (
    r"\bignore (all|any|previous|prior|the above)\b",
    r"\bdisregard (all|any|previous|prior|the above)\b",
    r"\byou (must|should|need to|are required to)\b",
    r"\b(system|assistant)\s*:",
    r"\bnew instructions?\b",
    r"\boverride\b.*\b(instruction|rule|system)\b",
    r"\bdo not (tell|inform|reveal)\b",
)
# Fixed value: what a cited key looks like.
CITE = r"\bmem_[a-zA-Z0-9][a-zA-Z0-9_-]*_v\d+\b"

WHITE = r"\s\x1c-\x1f"


def strip(text: Column) -> Column:
    """Without white space at both ends, of any kind that Unicode knows."""
    return F.regexp_replace(text, rf"(?U)\A[{WHITE}]+|(?<![{WHITE}])[{WHITE}]+\z", "")


def normalize_text(text: Column) -> Column:
    """Lower case, runs of white space to one space, trimmed: variants are the same content."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)[\s\x1c-\x1f]+", " "))


def content_digest(text: Column) -> Column:
    return F.sha2(normalize_text(text), 256)


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), content_digest(text))


def vector_key(agent: Column, task: Column, digest: Column, version: Column) -> Column:
    return F.concat(F.lit("mem_"), agent, F.lit("_"), task, F.lit("_"), F.substring(digest, 1, 16), F.lit("_v"), version.cast("string"))


def estimate_tokens(text: Column) -> Column:
    return F.coalesce(F.floor((F.char_length(text) + 3) / 4), F.lit(0)).cast("long")


def summary_required(text: Column) -> Column:
    return F.coalesce((estimate_tokens(text) > S.SUMMARY_MIN_TOKENS) | (F.octet_length(text) > S.SUMMARY_MIN_BYTES), F.lit(False))


def preview(summary: Column, content: Column, chars: int = S.PREVIEW_CHARS) -> Column:
    """The summary where there is one, else the content cut to ``chars`` with an ellipsis."""
    cut = F.when(F.char_length(content) > chars, F.concat(F.substring(content, 1, chars), F.lit("…"))).otherwise(F.nullif(content, F.lit("")))
    return F.coalesce(F.nullif(summary, F.lit("")), cut)


def extract_cites(*texts: Column) -> Column:
    """Keys cited in the texts, in order, each once."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(CITE), F.lit(0)) for t in texts]))


def injection_suspect(text: Column) -> Column:
    found = F.lit(False)
    for pattern in INJECTION_PATTERNS:
        found = found | F.coalesce(text.rlike(f"(?idU){pattern}"), F.lit(False))
    return found


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def working_set_task_id(name: Column) -> Column:
    name = F.trim(name)
    return F.when(name.startswith("working-set-"), name).otherwise(F.concat(F.lit("working-set-"), name))


def clean_source_identity(arn: Column, user_id: Column | None = None) -> Column:
    """A principal's name as the audit trail accepts it: what follows an ARN's last slash, else the user id,
    else ``unknown``; odd characters to '-', 64 characters, then without the reserved prefix."""
    raw = F.when(F.contains(arn, F.lit("/")), F.substring_index(arn, "/", -1)).otherwise(F.coalesce(F.nullif(user_id, F.lit("")) if user_id is not None else F.lit(None), F.lit("unknown")))
    cut = F.substring(F.regexp_replace(raw, r"(?U)[^\w+=,.@-]", "-"), 1, 64)
    return F.coalesce(F.nullif(F.regexp_replace(cut, r"^(?:aws:)+", ""), F.lit("")), F.lit("unknown"))


def rubric_match(answer: Column, groups: list[list[str]]) -> Column:
    """Every group has at least one of its terms in the answer."""
    low = F.lower(answer)
    ok = F.lit(True)
    for group in groups:
        hit = F.lit(False)
        for term in group:
            hit = hit | low.contains(term.lower())
        ok = ok & hit
    return F.coalesce(ok, F.lit(False))


def clean_keys(keys: Column) -> Column:
    return F.filter(F.transform(keys, lambda k: F.trim(k)), lambda k: k != "")
