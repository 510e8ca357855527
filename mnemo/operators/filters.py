"""Metadata filter documents compiled to columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemo import schema as S


class FilterError(ValueError):
    """A filter document the engine does not accept."""


def compile_filter(doc: dict, fields: dict[str, str] = S.FILTERABLE) -> Column:
    """Bare values mean equality; on list fields equality means any element. Absent fields never match.

    Operators: $and $or over lists of documents; $eq $ne $gt $gte $lt $lte $in $nin $exists on fields.
    """
    parts = []
    for name, value in doc.items():
        if name in ("$and", "$or"):
            if not isinstance(value, list) or not value:
                raise FilterError(f"{name} takes a non-empty list")
            parts.append(reduce((lambda a, b: a & b) if name == "$and" else (lambda a, b: a | b), [compile_filter(v, fields) for v in value]))
        elif name not in fields:
            raise FilterError(f"{name} is not filterable")
        elif isinstance(value, dict):
            parts += [_operator(name, fields[name], op, v) for op, v in value.items()]
        else:
            parts.append(_operator(name, fields[name], "$eq", value))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _operator(name: str, kind: str, op: str, value) -> Column:
    field, is_list = F.col(name), kind == "list"
    if op == "$exists":
        return field.isNotNull() if value else field.isNull()
    if op in ("$gt", "$gte", "$lt", "$lte"):
        if kind != "number" or isinstance(value, bool) or not isinstance(value, int | float):
            raise FilterError(f"{op} compares numbers")
        return {"$gt": field > value, "$gte": field >= value, "$lt": field < value, "$lte": field <= value}[op]
    if op in ("$in", "$nin"):
        if not isinstance(value, list | tuple) or not value:
            raise FilterError(f"{op} takes a non-empty list")
        found = F.arrays_overlap(field, F.array(*[F.lit(v) for v in value])) if is_list else field.isin(list(value))
        return found if op == "$in" else ~found
    if op in ("$eq", "$ne"):
        found = F.array_contains(field, value) if is_list else field == value
        return found if op == "$eq" else ~found
    raise FilterError(f"{op} is not an operator")


def allowed_indexes(role: str) -> Column:
    """The mandatory predicate of a role; unknown roles may read nothing."""
    return F.col("index_name").isin(list(S.ROLE_INDEXES.get(role, ())))


def check_verb(role: str, verb: str) -> None:
    """Raise unless the role may use the verb: read-only roles read, unknown roles and verbs do nothing."""
    allowed = S.READ_ONLY_VERBS if role in S.READ_ONLY_ROLES else (*S.READ_ONLY_VERBS, *S.WRITE_VERBS)
    if role not in S.ROLE_INDEXES or verb not in allowed:
        raise PermissionError(f"{role} may not {verb}")
