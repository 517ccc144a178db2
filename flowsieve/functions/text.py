"""String, hash and JSON expressions; all of them stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(c: Column, variant: str = "a") -> Column:
    """Column-name spelling. a: lower, other characters to one underscore, stripped; b: trim, white space to one
    underscore, case kept; c: lower, white space to one underscore; d: lower, each blank to an underscore."""
    if variant == "a":
        return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    if variant == "b":
        return F.regexp_replace(F.trim(c), r"\s+", "_")
    if variant == "c":
        return F.regexp_replace(F.lower(F.trim(c)), r"\s+", "_")
    return F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit("_"))


def sanitized(c: Column) -> Column:
    """Safe file token: forbidden characters and blanks to one underscore, dots and underscores stripped, empty to NA."""
    token = F.regexp_replace(F.regexp_replace(F.trim(c), r'[\\/:*?"<>|\s]+', "_"), "_+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(token, r"^[._]+|[._]+$", ""), F.lit("")), F.lit("NA"))


def alnum(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def case_key(*parts: Column) -> Column:
    return F.concat_ws("::", *parts)


def base_feature(c: Column) -> Column:
    """`name=category` of a one-hot column to `name`."""
    return F.substring_index(c, "=", 1)


def part_of(unit: Column) -> Column:
    """struct(part, parts) of `name::part<i>of<k>`; (1, 1) for a whole file."""
    pattern = r"part(\d+)of(\d+)"
    has = unit.rlike(pattern)
    number = lambda g: F.when(has, F.regexp_extract(unit, pattern, g)).otherwise("1").cast("int")
    return F.struct(number(1).alias("part"), number(2).alias("parts"))


def short_hash(c: Column, n: int = 12, kind: str = "sha1") -> Column:
    digest = {"sha1": F.sha1(c), "md5": F.md5(c), "sha256": F.sha2(c, 256)}[kind]
    return F.substring(digest, 1, n)


def shown(x: Column) -> Column:
    """Numbers from 1000 without decimals, smaller ones with four, missing ones empty."""
    return F.when(x.isNull() | F.isnan(x), "").when(F.abs(x) >= 1000, F.format_string("%,d", F.rint(x).cast("long"))).otherwise(F.format_string("%.4f", x))
