"""Languages of documents and of their passages, by a bidirectional GRU over bytes."""

from __future__ import annotations

import hashlib
import inspect
import io
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import cut_lineage, fetch, path_exists, shared_folder, store
from . import gru
from .bpe import spread
from .gru import ByteTagger, train

# The languages told apart, with codes and names in use for them.
LANGUAGES = {
    "en": "en eng english anglais inglés englisch",
    "de": "de deu ger german deutsch",
    "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castellano",
    "pt": "pt por portuguese português portugues",
    "it": "it ita italian italiano",
    "nl": "nl nld dut dutch nederlands flemish",
    "tr": "tr tur turkish türkçe turkce",
    "ru": "ru rus russian русский",
}
# Two-letter codes of other languages; a label with one of them is wrong, not missing.
OTHER_CODES = "ar bg bn ca cs cy da el et eu fa fi ga gl he hi hr hu hy id is ja ka kk ko lt lv mk ms mt nb nn no pl ro sk sl sq sr sv sw ta te th uk ur vi zh".split()
CODES = list(LANGUAGES)

#: Labelled documents per language that the network is fitted on, those with the lowest hashes.
SAMPLE_PER_LANGUAGE = 300
#: Segments per labelled document that are learnt from, and characters of a segment.
SEGMENTS_PER_DOCUMENT = 12
STEPS = (200, 340)
HIDDEN = 32
#: Letters of a labelled document that are brought to the driver.
SAMPLE_LETTERS = 4000
#: A further language needs a whole sentence with this probability.
SENTENCE_SURE = 0.95
#: Documents that must have a sentence before their languages count for it, and the share
#: of them that must agree.
COMPANY = 5
AGREED = 0.75
#: Weight of a document's other sentences in a sentence's prior; the rest is even.
OTHERS = 0.95
#: Segments whose probabilities a worker remembers; only speed depends on it.
KNOWN_SEGMENTS = 200_000

_CODE = re.compile(r"```.*?(?:```|$)|~~~.*?(?:~~~|$)|<\|\w+\|>|</?[a-zA-Z][^<>]*>|&[a-z]+;|&#\d+;|https?://\S+", re.DOTALL)
_NAME = re.compile(r"\S*(?:\w_\w|\w/\w|\\\w|\w\.\w|\w=\w|\d:)\S*")
_END = re.compile(r"(?<=[.!?…])[\"'”“»’)\]]*\s+(?=[\W_]*\w)|\n+|(?<=[。！？])")
_LETTERS = re.compile(r"[^\W\d_]{2,}")
_WHOLE = r"[.!?…][\"'”“»’)\]]*$"
_THOUGHT = re.compile(r'"(?:thought|text|content|reason|comment|note)"\s*:\s*"((?:[^"\\]|\\.)*)"?', re.DOTALL)
_ZERO = dict.fromkeys(map(ord, "​‌‍⁠﻿­"))


def label_code(c: Column) -> Column:
    """The two-letter code that a label names, 'xx' for a language outside the nine,
    null if it names none. Codes, regions and names are read in any case."""
    head = F.regexp_extract(F.lower(F.trim(c)), r"^[\s]*([\p{L}]+)", 1)
    known = F.create_map(*[F.lit(x) for code, names in LANGUAGES.items() for n in names.split() for x in (n, code)])
    return F.coalesce(known[head], F.when(head.isin(OTHER_CODES), F.lit("xx")))


def _unwrapped(text: str) -> str:
    """Texts of JSON objects instead of the objects; other objects fall away."""
    out, at = [], 0
    decoder = json.JSONDecoder()
    for m in re.finditer(r"[{\[]\s*[\"{\[]", text):
        if m.start() < at:
            continue
        out.append(text[at : m.start()])
        try:
            value, end = decoder.raw_decode(text, m.start())
            out.append("\n" + "\n".join(_texts(value)) + "\n")
            at = end
        except (ValueError, RecursionError):
            # Damaged: the texts in it count up to the end of its line, and reading goes on behind.
            at = text.find("\n", m.start()) if "\n" in text[m.start() :] else len(text)
            out.append("\n" + "\n".join(x.replace("\\n", "\n").replace('\\"', '"') for x in _THOUGHT.findall(text[m.start() : at])) + "\n")
    return "".join(out) + text[at:]


def _texts(value: object, key: str = "") -> list[str]:
    if isinstance(value, dict):
        return [t for k, v in value.items() for t in _texts(v, k)]
    if isinstance(value, list):
        return [t for v in value for t in _texts(v, key)]
    return [value] if isinstance(value, str) and key in ("thought", "text", "content", "reason", "comment", "note") else []


def segments(text: str | None) -> list[str]:
    """The sentences of a text without mark-up, code, tool names and keys."""
    if not text:
        return []
    plain = _CODE.sub(" ", _unwrapped(_CODE.sub(" \n", unicodedata.normalize("NFKC", text).translate(_ZERO))))
    out = []
    for line in _END.split(plain):
        s = " ".join(_NAME.sub(" ", line).split()).strip(" -*>#|•\t")
        if len(_LETTERS.findall(s)) > 1:
            out.append(s)
    return out


def letters(segment: str) -> int:
    return sum(map(len, _LETTERS.findall(segment)))


def as_bytes(segment: str) -> bytes:
    return (" " + re.sub(r"\d+", "0", segment.lower()) + " ").encode()


def _bare(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))


def _slips(s: str, rng: np.random.Generator) -> str:
    """s with a few neighbouring letters swapped and letters left out."""
    c = list(s)
    for i in rng.integers(0, max(1, len(c) - 1), max(1, len(c) // 20)).tolist():
        if c[i : i + 2] and "".join(c[i : i + 2]).isalpha() and len(c[i : i + 2]) == 2:
            c[i], c[i + 1] = (c[i + 1], c[i]) if i % 2 else ("", c[i + 1])
    return "".join(c)


def fit(documents: DataFrame, text: str, lang: str, key: str, per_language: int = SAMPLE_PER_LANGUAGE, seed: int = 5) -> dict[str, np.ndarray] | None:
    """Weights fitted on the labelled documents with the lowest hashes, at most
    per_language of each language; None without any. Of a text the first SAMPLE_LETTERS
    letters come to the driver, so what is collected is bounded; labelling reads whole texts.

    The same sample, settings and network have the same weights. They are kept in the shared
    folder under the fingerprint of all three, so they are fitted once a corpus.

    Labels are noisy: after a first fit, segments that the network is sure to be of
    another language than their document's label are left out of the second.
    """
    ranked = documents.select(F.substring(F.col(text), 1, SAMPLE_LETTERS).alias("t"), label_code(F.col(lang)).alias("l"), F.xxhash64(F.lit(seed), F.col(key)).alias("h")).where("l <> 'xx' and length(t) > 20")
    first = W.partitionBy("l").orderBy("h", "t")
    rows = ranked.withColumn("r", F.row_number().over(first)).where(F.col("r") <= per_language).select("t", "l", "h").collect()
    found, labels = [], []
    for r in sorted(rows, key=lambda r: (r["h"], r["t"])):
        for s in segments(r["t"])[:SEGMENTS_PER_DOCUMENT]:
            if letters(s) >= 8:
                found.append(s)
                labels.append(CODES.index(r["l"]))
    if not found:
        return None
    mark = hashlib.sha256(json.dumps([found, labels, STEPS, seed, HIDDEN, inspect.getsource(gru)]).encode()).hexdigest()[:24]
    kept_at = f"{shared_folder(documents.sparkSession)}/language-{mark}.npz"
    if path_exists(documents.sparkSession, kept_at):
        with np.load(io.BytesIO(fetch(kept_at))) as z:
            return {k: z[k] for k in z.files}

    rng = np.random.default_rng(seed)

    def written(ss: list[str]) -> list[bytes]:
        # One in six without accents, one in twelve with slips, one in twenty-four wrongly
        # decoded, as some writers have it.
        return [as_bytes(_bare(s) if i % 6 == 0 else _slips(s, rng) if i % 12 == 3 else s.encode().decode("cp1252", "replace") if i % 24 == 5 else s) for i, s in enumerate(ss)]

    net = train(written(found), labels, len(CODES), STEPS[0], seed=seed, hidden=HIDDEN)
    sure = net.pooled([as_bytes(s) for s in found])
    kept = [i for i, y in enumerate(labels) if sure[i, y] > 0.2]
    net = train(written([found[i] for i in kept]), [labels[i] for i in kept], len(CODES), STEPS[1], seed=seed + 1, rate=0.006, net=net)
    packed = io.BytesIO()
    np.savez(packed, **net.weights())
    store(kept_at, packed.getvalue())
    return net.weights()


class Labeller:
    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.net = ByteTagger.from_weights(weights)
        self.known: dict[bytes, np.ndarray] = {}

    def probs(self, segs: list[bytes]) -> list[np.ndarray]:
        new = sorted({s for s in segs if s not in self.known})
        if len(self.known) + len(new) > KNOWN_SEGMENTS:
            self.known = {}
            new = sorted(set(segs))
        for s, p in zip(new, self.net.pooled(new) if new else []):
            self.known[s] = p.astype(np.float32)
        return [self.known[s] for s in segs]

    def label(self, texts: list[str | None]) -> list[tuple]:
        """(main language, confidence, segments, their languages, confidences, letters)."""
        split = [segments(t) for t in texts]
        flat = self.probs([as_bytes(s) for ss in split for s in ss])
        out, at = [], 0
        for ss in split:
            p = flat[at : at + len(ss)]
            at += len(ss)
            if not ss:
                out.append((None, 0.0, [], [], [], []))
                continue
            p = np.array(p, np.float64)
            n = np.array([letters(s) for s in ss], np.float64)
            share = (p * n[:, None]).sum(0)
            main = int(share.argmax())
            # A sentence is read in the light of the others: a language that they don't
            # have needs so much more from the sentence itself.
            others = (share - p * n[:, None]) / np.maximum(n.sum() - n, 1)[:, None]
            p = p * (OTHERS * others + (1 - OTHERS) / len(CODES)) if len(ss) > 1 else p
            p /= p.sum(1, keepdims=True)
            best, sure = p.argmax(1), p.max(1)
            weak = sure < SENTENCE_SURE
            # An unsure sentence goes with its document.
            lang = np.where(weak, main, best)
            conf = np.where(weak, p[:, main], sure)
            total = np.bincount(lang, n, len(CODES))
            main = int(total.argmax())
            weight = float((p[:, main] * n).sum() / n.sum())
            out.append((CODES[main], weight, ss, [CODES[i] for i in lang], conf.tolist(), n.astype(int).tolist()))
        return out


def label_documents(df: DataFrame, key: str, text: str, keep: list[str], weights: dict[str, np.ndarray] | None) -> DataFrame:
    """key, the kept columns, main, confidence and segs (array of segment, lang,
    confidence, letters); main is null for texts without words. Whole texts are read."""
    cols = [key, *keep]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols) + ", main string, confidence double, segs array<struct<segment: string, lang: string, confidence: double, letters: int>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(weights) if weights else None
        for b in batches:
            out = b[cols].copy()
            got = labeller.label([t if isinstance(t, str) else None for t in b["_text"].tolist()]) if labeller else [(None, 0.0, [], [], [], [])] * len(b)
            out["main"] = [g[0] for g in got]
            out["confidence"] = [g[1] for g in got]
            out["segs"] = [[{"segment": s, "lang": x, "confidence": c, "letters": n} for s, x, c, n in zip(*g[2:])] for g in got]
            yield out

    return spread(df.select(*cols, F.col(text).alias("_text")), key).mapInPandas(run, schema)


def by_company(labelled: DataFrame, key: str) -> DataFrame:
    """labelled with sentences put right by the company they keep.

    A sentence that COMPANY documents or more have (by its letters, case apart), of which a
    share of AGREED have one main language, is of that language, whatever the network
    says of it; main languages are then told anew. The counts cover all documents, a
    document counts once a sentence, and what is shuffled are hashes.
    """
    whole = cut_lineage(labelled)
    plain = F.xxhash64(F.trim(F.regexp_replace(F.lower("s.segment"), r"[^\p{L}]+", " ")))
    each = whole.where("main is not null").select(key, "main", F.posexplode("segs").alias("pos", "s")).select(key, "main", "pos", plain.alias("h"), F.col("s.lang").alias("said"))
    once = each.groupBy("h", key).agg(F.min("main").alias("main"), F.min("said").alias("said"))
    counts = once.groupBy("h", "main").agg(F.count("*").alias("n"), F.count_if(F.col("said") != F.col("main")).alias("odd"))
    told = counts.groupBy("h").agg(F.sum("n").alias("whole"), F.sum("odd").alias("odd"), F.max(F.struct("n", "main")).alias("top"))
    # A sentence that is never told otherwise than its documents needs no look.
    right = told.where((F.col("odd") > 0) & (F.col("whole") >= COMPANY) & (F.col("top.n") >= AGREED * F.col("whole"))).select("h", F.col("top.main").alias("lang"), (F.col("top.n") / F.col("whole")).alias("share"))
    better = each.join(right, "h").where("said <> lang").groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("pos", F.struct("lang", "share")))).alias("_b"))
    put = lambda s, i: F.when(F.col("_b")[i].isNotNull(), F.struct(s["segment"].alias("segment"), F.col("_b")[i]["lang"].alias("lang"), F.col("_b")[i]["share"].alias("confidence"), s["letters"].alias("letters"))).otherwise(s)
    joined = whole.join(better, key, "left").withColumn("segs", F.when(F.col("_b").isNull(), F.col("segs")).otherwise(F.transform("segs", put)))
    total = F.transform(F.array(*map(F.lit, CODES)), lambda c: F.struct(F.aggregate(F.filter("segs", lambda s: s["lang"] == c), F.lit(0).cast("bigint"), lambda a, s: a + s["letters"]).alias("n"), c.alias("lang")))
    main = F.when(F.col("_b").isNull(), F.col("main")).otherwise(F.array_max(total)["lang"])
    return joined.withColumn("main", main).drop("_b")


def label_defects(labelled: DataFrame, key: str, lang: str) -> DataFrame:
    """key, defect, lang: 'missing' or 'wrong' labels with the main language, and
    'mixed' with each further language of a whole sentence. Texts without words give none."""
    code = label_code(F.col(lang))
    known = labelled.where("main is not null")
    label = F.when(code.isNull(), F.lit("missing")).when(code != F.col("main"), F.lit("wrong"))
    whole = F.filter("segs", lambda s: (s["lang"] != F.col("main")) & (s["confidence"] >= SENTENCE_SURE) & s["segment"].rlike(_WHOLE))
    rows = F.concat(
        F.filter(F.array(F.struct(label.alias("defect"), F.col("main").alias("lang"))), lambda x: x["defect"].isNotNull()),
        F.transform(F.array_distinct(F.transform(whole, lambda s: s["lang"])), lambda x: F.struct(F.lit("mixed").alias("defect"), x.alias("lang"))),
    )
    return known.select(key, F.explode(rows).alias("x")).select(key, "x.defect", "x.lang")
