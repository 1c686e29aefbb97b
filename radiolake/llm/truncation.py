"""Texts that were cut off when they were stored.

Three kinds of evidence, from the strongest down: a mark left at the break; a stack
automaton over brackets, quotes, fences, escapes and markup that ends unclosed; and,
for prose that ends in a bare word, how the corpus goes on after the same words. A
source whose texts normally end without terminators gives many bare endings to the
same words; a cut gives an ending where the corpus nearly always continues, has the
longer word, or has the full stop.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut_lineage

# What writers put where they cut.
_MARK = re.compile(r"(?:…|\.\.\.|[\[<(]\s*(?:…|\.\.\.|truncated|cut|cut off|more|snip|snipped|continued|abridged)\s*[\])>])\s*$", re.IGNORECASE)
_SIGNS = re.compile(r"```|\\.?|[\"{}\[\]()“”„«»]", re.DOTALL)
_HALF = re.compile(r"(?:�+|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?|&(?:#[0-9]{0,6}|[a-z]{1,7})|<[/a-zA-Z][^<>]*)$")
_STOP = re.compile(r"[.!?。！？؟\]})>\"”»'’*`]\s*$")
_DANGLING = re.compile(r"[,;:\-–—(\[{/&+=«„“|\\]\s*$")
_CLOSES = {"}": "{", "]": "[", ")": "(", "”": "“", "»": "«"}

#: An ending is established if at least this share of the occurrences of its words ends so.
ESTABLISHED = 0.35
#: Other occurrences that a context needs before it decides; else the next shorter one does.
SUPPORT = 4
#: Share of terminated texts from which on a source's bare ending without any evidence counts as cut.
BASELINE = 0.8


def left_open(text: str) -> bool:
    """True if the automaton ends inside a bracket, string, fence, escape or tag.

    Double quotes count inside braces and square brackets only; closing signs without
    an opening one are ignored, as prose has them.
    """
    stack: list[str] = []
    string = fence = False
    for m in _SIGNS.finditer(text):
        s = m.group()
        if string:
            if s == '"':
                string = False
            continue
        if s == "```":
            fence = not fence
            if not fence:
                stack.clear()
        elif s == '"':
            string = bool(stack) and stack[-1] in "{["
        elif s == "“" and stack and stack[-1] == "„":
            stack.pop()
        elif s == "”" and stack and stack[-1] == "„":
            stack.pop()
        elif s in "{[(“„«":
            stack.append(s)
        elif s in _CLOSES:
            if _CLOSES[s] in stack:
                while stack.pop() != _CLOSES[s]:
                    pass
    return string or fence or bool(stack) or bool(_HALF.search(text))


def shape(text: str) -> str:
    """'marked', 'open', 'json', 'stop', 'dangling' or 'word' for a non-blank text."""
    body = text.strip()
    if _MARK.search(body):
        return "marked"
    if left_open(body):
        return "open"
    if body[0] in "{[" and body[-1] in "}]" or body.startswith("```"):
        return "json"
    if _STOP.search(body):
        return "stop"
    return "dangling" if _DANGLING.search(body) else "word"


def shapes(texts: DataFrame, text: str = "text") -> DataFrame:
    """texts with the column shape; null and blank texts are left out."""
    kept = texts.where(F.col(text).rlike(r"[^\s\p{Z}​﻿]"))

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(shape)

    return kept.withColumn("shape", run(F.col(text)))


def _grams(plain: DataFrame) -> DataFrame:
    """Every word of plain (columns source, text, shape) with the two before it: t1, t2,
    t3, at_end (the text ends bare here) and how ('bare', 'stop', 'on' or null)."""
    words = plain.select("kind", "shape", F.filter(F.split(F.regexp_replace(F.lower("text"), r"\d", "#"), r"[\s\p{Z}]+"), lambda x: x != "").alias("w"))
    n = F.size("w")

    def gram(x: Column, i: Column) -> Column:
        before = F.when(i >= 1, F.get("w", i - 1))
        earlier = F.when(i >= 2, F.get("w", i - 2))
        fresh1 = before.isNull() | before.rlike(r"[.;:!?][\"”»)\]]*$")
        fresh2 = fresh1 | earlier.isNull() | earlier.rlike(r"[.;:!?][\"”»)\]]*$")
        last = i == n - 1
        how = (
            F.when(last & (F.col("shape") == "word"), F.lit("bare"))
            .when(x.rlike(r"[.!?…][\"”»)\]]*$"), F.lit("stop"))
            .when(x.rlike(r";[\"”»)\]]*$") | (~last & F.coalesce(F.get("w", i + 1).startswith("("), F.lit(False))), F.lit(None))
            .when(x.endswith(":") & (i == 0), F.lit("bare"))
            .when(~last, F.lit("on"))
        )
        return F.struct(F.when(fresh2, F.lit("^")).otherwise(earlier).alias("t1"), F.when(fresh1, F.lit("^")).otherwise(before).alias("t2"), F.regexp_replace(x, r"[\p{P}&&[^_#]]+$", "").alias("t3"), how.alias("how"))

    return words.select("kind", F.explode(F.transform("w", gram)).alias("g")).select("kind", "g.*").where("how is not null and t3 <> ''")


def _last_gram() -> list[Column]:
    w = F.filter(F.split(F.regexp_replace(F.lower("text"), r"\d", "#"), r"[\s\p{Z}]+"), lambda x: x != "")
    tail = F.slice(w, F.greatest(F.size(w) - 2, F.lit(1)), 3)
    size = F.size(tail)
    get = lambda k: F.when(size > k, F.get(tail, size - 1 - k))
    ends = lambda c: c.isNull() | c.rlike(r"[.;:!?][\"”»)\]]*$")
    b, e = get(F.lit(1)), get(F.lit(2))
    return [
        F.when(ends(b) | ends(e), F.lit("^")).otherwise(e).alias("t1"),
        F.when(ends(b), F.lit("^")).otherwise(b).alias("t2"),
        F.regexp_replace(get(F.lit(0)), r"[\p{P}&&[^_#]]+$", "").alias("t3"),
    ]


def _evidence(counts: DataFrame, asked: DataFrame, context: list[str], k: int) -> DataFrame:
    """For each asked (context, t3): e{k} bare endings, x{k} all other occurrences,
    counting longer words that begin with t3 among the latter.

    Longer words are found from the endings asked for: a word is cut to the lengths
    only that endings of its context and first letter have, so a word without blanks,
    however long, gives no more rows than there are such lengths.
    """
    asked = asked.select(*context, "t3").distinct()
    head = F.substring("t3", 1, 2).alias("_h")
    # An ending of one letter asks for all words of its letter, longer ones for those of their first two.
    lengths = asked.where(F.length("t3") > 1).groupBy(*context, head).agg(F.collect_set(F.length("t3")).alias("_n")).unionByName(asked.where(F.length("t3") == 1).select(*context, F.col("t3").alias("_h"), F.array(F.lit(1)).alias("_n")))
    heads = F.explode(F.array_distinct(F.array(F.substring("t3", 1, 1), F.substring("t3", 1, 2)))).alias("_h")
    longer = counts.where(F.length("t3") > 1).select(*context, "t3", (F.col("bare") + F.col("other")).alias("other"), heads).join(lengths, [*context, "_h"])
    longer = longer.select(*context, F.explode(F.filter("_n", lambda n: n < F.length("t3"))).alias("_c"), "t3", "other").select(*context, F.substring("t3", F.lit(1), F.col("_c")).alias("t3"), F.lit(0).alias("bare"), "other")
    both = counts.select(*context, "t3", "bare", "other").unionByName(longer).join(asked, [*context, "t3"], "left_semi")
    return both.groupBy(*context, "t3").agg(F.sum("bare").alias(f"e{k}"), F.sum("other").alias(f"x{k}"))


def judge(texts: DataFrame, key: list[str], kind: str) -> DataFrame:
    """key, source, shape, cut (boolean, never null) for every non-blank text.

    texts: the key columns, source, text. kind, one of the keys, names the field that a
    text was stored in: texts of other fields are no evidence. Counts and baselines
    cover all texts; repeated rows should be dropped before. Null and blank texts give
    no row.
    """
    # Written once, with the texts: the automaton, which is the dear part, and the word counts
    # are read by several branches.
    seen = cut_lineage(shapes(texts.select(*key, F.col(kind).alias("kind"), "source", "text")))
    sure = seen.where("shape <> 'word'").select(*key, "source", "shape", F.col("shape").isin("marked", "open", "dangling").alias("cut"))
    grams = _grams(seen.where("shape in ('word', 'stop', 'dangling')")).groupBy("kind", "t1", "t2", "t3")
    tri = cut_lineage(grams.agg(F.sum((F.col("how") == "bare").cast("long")).alias("bare"), F.sum((F.col("how") != "bare").cast("long")).alias("other")))
    bi = tri.groupBy("kind", "t2", "t3").agg(F.sum("bare").alias("bare"), F.sum("other").alias("other"))
    uni = tri.groupBy("kind", "t3").agg(F.sum("bare").alias("bare"), F.sum("other").alias("other"))
    ends = seen.where("shape = 'word'").select(*key, "kind", "source", "shape", *_last_gram())
    asked = cut_lineage(ends.select("kind", "t1", "t2", "t3").distinct())
    known = asked
    for counts, context, k in ((tri, ["kind", "t1", "t2"], 3), (bi, ["kind", "t2"], 2), (uni, ["kind"], 1)):
        known = known.join(_evidence(counts, asked, context, k), [*context, "t3"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    share = F.lit(None).cast("double")
    for k in (1, 2, 3):
        e, x = zero(f"e{k}"), zero(f"x{k}")
        share = F.when(e - 1 + x >= SUPPORT, e / (e + x)).otherwise(share)
    known = known.select("kind", "t1", "t2", "t3", share.alias("ends_share"))
    usual = seen.where("shape in ('word', 'stop', 'dangling')").groupBy("kind", "source").agg(F.avg((F.col("shape") == "stop").cast("double")).alias("stops")).select(F.col("kind").alias("_k"), F.col("source").alias("_s"), "stops")
    cut = F.when(F.col("ends_share").isNotNull(), F.col("ends_share") < ESTABLISHED).otherwise(F.coalesce(F.col("stops") >= BASELINE, F.lit(False)))
    judged = ends.join(known, ["kind", "t1", "t2", "t3"], "left").join(usual, (F.col("kind") == F.col("_k")) & F.col("source").eqNullSafe(F.col("_s")), "left")
    return sure.unionByName(judged.select(*key, "source", "shape", cut.alias("cut")))
