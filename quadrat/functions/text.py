"""Digests, paths, prompts and spans as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def digest(data) -> Column:
    return F.sha2(_col(data), 256)


def canonical(**fields: Column) -> Column:
    """Compact JSON with sorted keys; null fields stay, as null."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def canonical_map(values) -> Column:
    """The entries of a map as compact JSON, sorted by key."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(_col(values)))))


def path_fault(path) -> Column:
    """'unsafe_artifact_path' for an empty, absolute or upward path, else null."""
    p = _col(path)
    bad = p.isNull() | (p == "") | p.startswith("/") | p.rlike(r"(^|/)\.\.(/|$)") | p.contains("\\")
    return F.when(bad, "unsafe_artifact_path")


def public_version(version) -> Column:
    return F.split_part(_col(version), F.lit("+"), F.lit(1))


def stem_sequence(stem) -> Column:
    """The text before the first underscore."""
    return F.split_part(_col(stem), F.lit("_"), F.lit(1))


def _phrase(p: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(p)), r"\.+$", "")


def build_prompt(phrases) -> Column:
    """Lower-case phrases, each ended by one period, joined by spaces."""
    return F.concat_ws(" ", F.transform(_col(phrases), lambda p: F.concat(_phrase(p), F.lit("."))))


def map_span(span, phrases) -> Column:
    """The prompted phrase that a span names: equal first, then contained either way; the longest, then the first listed."""
    cleaned, all_of = _phrase(_col(span)), _col(phrases)
    equal = F.filter(all_of, lambda p: _phrase(p) == cleaned)
    close = F.filter(all_of, lambda p: F.lower(F.trim(p)).contains(cleaned) | cleaned.contains(F.lower(F.trim(p))))
    found = F.when(F.size(equal) > 0, equal).otherwise(close)
    longest = F.array_max(F.transform(found, lambda p: F.length(p)))
    return F.when(cleaned != "", F.get(F.filter(found, lambda p: F.length(p) == longest), F.lit(0)))
