"""Scalar expressions on text, paths and time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID = "(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"


def raw_tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits of any alphabet. Cut at what is between them: regexp_extract_all() copies the text for each match."""
    return F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def slugify(c: Column) -> Column:
    s = F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9\s-]", "")
    return F.regexp_replace(F.regexp_replace(s, r"[\s-]+", "-"), "^-+|-+$", "")


def path_ident(c: Column, prefix: str = "") -> Column:
    """A relative path without its extension."""
    return F.concat(F.lit(prefix), F.regexp_replace(c, r"\.[A-Za-z0-9]+$", ""))


def directory(c: Column) -> Column:
    return F.regexp_extract(c, "^(.*/)?", 0)


HEADING = r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$"


def heading_level(line: Column) -> Column:
    """1 to 6, 0 where the line is no heading."""
    return F.length(F.regexp_extract(line, HEADING, 1))


def heading_text(line: Column) -> Column:
    return F.trim(F.regexp_extract(line, HEADING, 2))


def normalize_body(c: Column) -> Column:
    """LF ends of lines, no trailing blanks but the two of a hard break, one blank line at most, one newline at the end."""
    s = F.regexp_replace(c, r"\r\n?", "\n")
    s = F.regexp_replace(s, r"(?m)(?<=\S)[ \t]*?(  )?[ \t]*$", "$1")
    s = F.regexp_replace(s, r"(?m)^[ \t]+$", "")
    s = F.regexp_replace(s, r"\n{3,}", "\n\n")
    s = F.regexp_replace(s, r"^\n+|\s+$", "")
    return F.when(s == "", "").otherwise(F.concat(s, F.lit("\n")))


def is_uuid(c: Column) -> Column:
    return c.rlike(UUID)


def keyword(c: Column) -> Column:
    """`:ns/name` without the colon."""
    return F.regexp_replace(c, "^:", "")


def millis_between(a: Column, b: Column) -> Column:
    return F.unix_millis(b) - F.unix_millis(a)
