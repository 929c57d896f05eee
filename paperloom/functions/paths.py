"""Path columns: last segment, suffix, stem. All stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def last_segment(path: Column) -> Column:
    """Text after the last slash (empty for a trailing slash)."""
    return F.substring_index(path, "/", -1)


def file_name(path: Column) -> Column:
    """Final path component, trailing slashes ignored."""
    return F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)


def suffix(path: Column) -> Column:
    """Last dot-suffix, dot included; empty when the name has none or starts with its only dot."""
    return F.regexp_extract(file_name(path), r"(?s)^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(file_name(path), r"(?s)^(.+)\.[^.]+$", "$1")
