"""Relevance and metadata scores as single column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemo import schema as S


def relevance(distance: Column) -> Column:
    return F.lit(1.0) - F.coalesce(distance, F.lit(0.0))


def base_score(mode: str, now: int, distance: Column, memory_type: Column, created_at: Column, confidence: Column, use_count: Column, last_used_at: Column) -> Column:
    """Relevance plus type boost, recency decay of episodes, confidence and popularity."""
    score = relevance(distance)
    if mode == "semantic":
        return score
    if mode == "procedural":
        score = score + F.when(memory_type == "procedural", F.lit(S.PROCEDURAL_BOOST)).otherwise(F.lit(0.0))
    else:
        score = score + F.when(memory_type == "procedural", F.lit(S.BALANCED_PROCEDURAL)).when(memory_type == "semantic", F.lit(S.BALANCED_SEMANTIC)).otherwise(F.lit(0.0))
    age_days = F.greatest(F.lit(0.0), (F.lit(now) - created_at) / F.lit(86400.0))
    score = score - F.when((memory_type == "episodic") & (created_at != 0), F.least(F.lit(S.DECAY_MAX), F.lit(S.DECAY_PER_DAY) * age_days)).otherwise(F.lit(0.0))
    score = score + F.coalesce(F.lit(S.CONFIDENCE_WEIGHT) * confidence, F.lit(0.0))
    idle_days = F.when(F.coalesce(last_used_at, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (F.lit(now) - last_used_at) / F.lit(86400.0)))
    popularity = F.least(F.lit(S.POPULARITY_MAX), F.lit(S.POPULARITY_WEIGHT) * F.log(F.lit(1.0) + use_count) * F.pow(F.lit(0.5), idle_days / F.lit(float(S.POPULARITY_HALF_LIFE_DAYS))))
    return score + F.when(use_count > 0, popularity).otherwise(F.lit(0.0))
