"""Fixed values of the memory model: constants, field lists and result schemas."""

from __future__ import annotations

NO_EXPIRY = 9_999_999_999
INLINE_MAX_BYTES = 30_720
SUMMARY_MIN_TOKENS, SUMMARY_MIN_BYTES = 500, 2048
DEDUP_TOP_K, OVERSAMPLE, NEAR_DUPLICATE = 5, 20, 0.95
MAX_TOKENS, TOP_K, HYDRATE_MAX, PAGE_SIZE = 4000, 5, 8, 100
PREVIEW_CHARS = 512
SEARCH_TOP_K_MAX = 25
MMR_LAMBDA, SAME_CANONICAL, SAME_TASK = 0.75, 1.0, 0.5
POPULARITY_WEIGHT, POPULARITY_MAX, POPULARITY_HALF_LIFE_DAYS = 0.02, 0.04, 30
PROCEDURAL_BOOST, BALANCED_PROCEDURAL, BALANCED_SEMANTIC = 0.2, 0.1, 0.05
DECAY_MAX, DECAY_PER_DAY, CONFIDENCE_WEIGHT = 0.25, 0.008, 0.05
EXPAND_MAX_KEYS, EXPAND_DEPTH = 16, 1
SUPERSEDED_GRACE, ARCHIVED_GRACE = 7 * 86_400, 30 * 86_400
DELETE_CAP, DELETE_CAP_SHARE = 1000, 0.05
CHUNK_CHARS, CHUNK_SUMMARY_CHARS = 6000, 400
RERANK_HEAD, RERANK_CHARS = 10, 512
ID_CHARS, LINKED_MAX, FILTERABLE_BYTES = 128, 32, 2048
CACHE_TTL = 86_400

MEMORY_TYPES = ("episodic", "semantic", "procedural", "document", "chunk")
STATUSES = ("active", "superseded", "archived")
FILTERABLE = {
    "agent_id": "string", "team_id": "string", "task_id": "string", "canonical_id": "string", "memory_type": "string", "status": "string", "origin": "string",
    "created_at": "number", "expires_at": "number", "archived_at": "number", "version": "number", "parent_key": "string", "linked_ids": "list", "stored_by": "string",
}
# role -> indexes it may read
ROLE_INDEXES = {"planner": ("shared", "private-a"), "researcher": ("shared", "private-b"), "auditor": ("shared", "private-a", "private-b")}
READ_ONLY_VERBS = ("retrieve", "list", "get", "hydrate", "pack", "working_set", "expand", "linked_by", "search", "whoami")
WRITE_VERBS = ("store", "pin", "archive", "restore", "purge", "reinforce")
READ_ONLY_ROLES = ("auditor",)
