"""Path spellings reduced to places on a case-sensitive disk (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_text(c: Column) -> Column:
    """Trimmed of Unicode white space and zero-width marks; null stays null."""
    return F.regexp_replace(c, r"^[\s\p{Z}​﻿]+|[\s\p{Z}​﻿]+$", "")


def url_decoded(c: Column) -> Column:
    """%XX escapes decoded as UTF-8, a plain plus sign kept; a broken escape leaves the text."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(c, r"\+", "%2B")), c)


def place(c: Column) -> Column:
    """The place a path names: file: URIs decoded, back slashes turned, '.', '..' and
    empty segments resolved. Null and blank paths give null; case is kept."""
    text = clean_text(c)
    text = F.when(text.rlike(r"(?i)^file:"), url_decoded(F.regexp_replace(text, r"(?i)^file:(//)?(localhost(?=/))?", ""))).otherwise(text)
    text = F.regexp_replace(text, r"\\", "/")
    rooted = text.startswith("/")
    kept = F.aggregate(
        F.split(text, "/"),
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg.isin("", "."), acc)
        .when(
            seg == "..",
            F.when((F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(rooted, acc).otherwise(F.concat(acc, F.array(seg))),
        )
        .otherwise(F.concat(acc, F.array(seg))),
    )
    out = F.concat(F.when(rooted, F.lit("/")).otherwise(F.lit("")), F.array_join(kept, "/"))
    return F.when(text != "", out)


def basename(c: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(c, r"\\", "/"), r"([^/]*)/*$", 1)


def dirname(c: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(c, r"\\", "/"), r"(?s)^(.*?)/*[^/]*/*\z", 1)
