"""Broken prompt and response pairs, each with its type of defect."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut_lineage
from .labelmodel import Function, fit
from .words import FUNCTION_WORDS, function_word_scores, sign_scores, top_language

DEFECTS = {
    "empty": [Function("no_answer", 0.4, 1e-4), Function("blank", 0.4, 1e-4), Function("bare_shell", 0.4, 1e-4)],
    "truncated": [Function("marked", 0.3, 1e-4), Function("left_open", 0.5, 1e-4), Function("unfinished", 0.3, 1e-4)],
    "refusal": [Function("declines", 0.95, 2e-4), Function("opener", 0.6, 0.02), Function("defers", 0.3, 1e-3), Function("no_finding", 0.9, 0.3)],
    "copy": [Function("same_text", 0.9, 1e-4), Function("same_words", 0.97, 1e-3), Function("same_order", 0.95, 1e-3)],
    "other_language": [Function("function_words", 0.9, 3e-3), Function("letters", 0.75, 0.05), Function("corpus_words", 0.97, 1e-3)],
}
PRIORS = {"empty": 0.03, "truncated": 0.03, "refusal": 0.02, "copy": 0.02, "other_language": 0.02}
#: Posteriors from which on a defect is reported, validated on the labelled pairs of the tests.
CUTOFFS = {"empty": 0.5, "truncated": 0.5, "refusal": 0.5, "copy": 0.5, "other_language": 0.5}

_ZERO = dict.fromkeys(map(ord, "​‌‍⁠﻿­"))
_PROSE_KEYS = {"thought", "text", "content", "reasoning", "answer", "message", "reason", "comment", "summary"}
_FENCE = re.compile(r"```[a-zA-Z]*\s*|```")
_FINDINGS = re.compile(r"(?:^|(?<=\s))(?:findings?|befunde?|hallazgos|résultats?|conclusions?)\s*:\s*(?:\d{2}\s+[\w ]+(?:;\s*|$))+", re.IGNORECASE)
_THOUGHT = re.compile(r'"(?:thought|text|content)"\s*:\s*"((?:[^"\\]|\\.)*)"?', re.DOTALL)

# Ways to decline a task, by language; first person or the request as subject.
_DECLINES = re.compile(
    r"\bi (?:must|have to|need to) (?:decline|refuse|pass)|\bi (?:can(?:no|')t|can not|won't|will not|am unable to|am not able to|am not allowed to|am not permitted to|may not|would rather not|prefer not to|refuse to|decline to)"
    r" (?:help|assist|provide|give|offer|answer|comment|interpret|diagnose|read|do (?:this|that)|take part|discuss|make a diagnosis|share|judge|assess|respond|comply|fulfil|process)|outside (?:of )?what i (?:may|can|am)|no (?:assessment|diagnosis|answer|comment) will come from me|"
    r"something i (?:have to|must) leave to|(?:this|that|your) (?:request|question) (?:is|lies) (?:outside|beyond)|\bi leave (?:this|that) to|not something i (?:can|may)|"
    r"kann ich (?:leider )?nicht (?:helfen|beantworten|weiterhelfen)|nicht helfen|\bich (?:darf|kann|werde|möchte|will) (?:hier |dazu |leider |das |diese \w+ )*(?:kein|nicht)\w*(?: \w+){0,3} (?:diagnose|auskunft|stellen|geben|beurteilen|äußern|kommentieren|beantworten|helfen|befunden)|muss ich ablehnen|\bich lehne|gebe ich keine|dazu (?:sage|äußere) ich|überlasse ich|steht mir nicht zu|"
    r"je ne (?:peux|puis|suis|veux|souhaite|vais) pas (?:\w+ )?(?:répondre|aider|commenter|poser|donner|interpréter|autorisé|en mesure|habilité|vous aider)|m'est interdit|je préfère ne pas|je (?:dois|me vois contraint de) (?:refuser|décliner)|je refuse|je laisse (?:cela|cette)|hors de ce que je|aucun avis ne viendra|"
    r"no (?:puedo|podré|debo|quiero|voy a) (?:ayudar|responder|opinar|dar|interpretar|diagnosticar|comentar|contestar|atender)|no estoy autorizad|no me está permitido|debo rechazar|tengo que rechazar|rechazo (?:esta|la)|prefiero no|no me corresponde|eso lo dejo|fuera de lo que puedo|"
    r"não (?:posso|devo|vou) (?:ajudar|responder|opinar|dar|interpretar|comentar|fornecer)|não estou autorizad|devo recusar|tenho de recusar|prefiro não|"
    r"non (?:posso|devo|voglio) (?:aiutar|rispondere|dare|interpretare|commentare|fornire|esprimer)|non sono autorizzat|devo rifiutare|preferisco non|mi è vietato|"
    r"(?:kan|mag|wil) ik (?:u |je )?(?:hier |helaas |daar )*(?:niet|geen)|ik (?:kan|mag|wil) (?:hier |helaas |u |je |deze \w+ |dit )*(?:niet|geen)(?: \w+){0,3} (?:helpen|beantwoorden|geven|stellen|beoordelen)|moet ik weigeren|ik weiger|liever niet|"
    r"yardımcı olamam|yardım edemem|yanıtlayamam|cevap veremem|tanı koyamam|yorum yapamam|reddetmek zorunda|yetkim yok|"
    r"не могу (?:помочь|ответить|ставить|поставить|дать|комментировать|интерпретировать)|не вправе|вынужден\w* отказать|отказываюсь|мне запрещено|мне нельзя|предпочитаю не",
    re.IGNORECASE,
)
# Openers that often, but not only, come before a refusal.
_OPENER = re.compile(
    r"\bsorry\b|unfortunately|with regret|i regret|i apologi[sz]e|given my rules|to be clear|let me be open|looks like a patient|thanks for the image|leider|tut mir leid|bedaure|ehrlich gesagt|zu diesem bild|"
    r"désolé|malheureusement|pour être clair|je regrette|lo siento|por desgracia|lamento|para ser claro|desculp|infelizmente|mi dispiace|purtroppo|spiacente|helaas|het spijt me|üzgünüm|maalesef|извин|к сожалению|сожале",
    re.IGNORECASE,
)
# Handing the task to somebody else.
_DEFERS = re.compile(
    r"qualified person|contact a|see a (?:dentist|doctor)|consult a|leave to a|i hope you understand|anything else you need|ask a (?:dentist|doctor|professional)|"
    r"qualifizierte|fachperson|wenden sie sich|zahnarzt|personne qualifiée|consultez|adressez-vous|persona cualificada|consulte|profesional|pessoa qualificada|persona qualificata|gekwalificeerd|uzman|квалифицир|обратитесь",
    re.IGNORECASE,
)
_TOOTH = re.compile(r"(?<!\d)[1-4][1-8](?!\d)")


def content_value(content: str | None) -> object:
    """The JSON value that content is (fences taken off), else its text without invisible signs."""
    text = _FENCE.sub("", (content or "").translate(_ZERO)).strip()
    if text[:1] in '{["' or text in ("null", "true", "false"):
        try:
            return json.loads(text)
        except (ValueError, RecursionError):
            pass
    return text


def has_content(value: object) -> bool:
    if isinstance(value, dict):
        return any(has_content(v) for v in value.values())
    if isinstance(value, list):
        return any(has_content(v) for v in value)
    return bool(value.translate(_ZERO).strip()) if isinstance(value, str) else value is not None


def _strings(value: object, key: str, out: list[str]) -> None:
    if isinstance(value, dict):
        for k, v in value.items():
            _strings(v, k, out)
    elif isinstance(value, list):
        for v in value:
            _strings(v, key, out)
    elif isinstance(value, str) and key in _PROSE_KEYS:
        out.append(value)


def prose(content: str | None) -> str:
    """What content says in sentences: no keys, tool names, arguments or diagnoses."""
    value = content_value(content)
    if isinstance(value, str):
        if value[:1] in "{[":
            value = " ".join(x.replace('\\"', '"').replace("\\n", " ") for x in _THOUGHT.findall(value))
    else:
        out: list[str] = []
        _strings(value, "", out)
        value = " ".join(out)
    value = re.sub(r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}|\{[^{}]*(?:\{[^{}]*\}[^{}]*)*$", " ", value)
    return _FINDINGS.sub(" ", re.sub(r"\w+_\w+", " ", value)).strip()


def _plain(content: str | None) -> str:
    """content as text to compare: for JSON its texts, else all of it."""
    value = content_value(content)
    if isinstance(value, str):
        return value
    out: list[str] = []
    _strings(value, "", out)
    return " ".join(out)


_WORDS = re.compile(r"\w+")
_LEAD = re.compile(r"^\s*(?:>|-|\*|q:|question:|user:|you asked:|frage:|pregunta:|question :|answer:|a:)+\s*", re.IGNORECASE)


def copy_votes(question: str | None, answer: str | None) -> tuple[int, int, int]:
    q, a = _WORDS.findall(_LEAD.sub("", _plain(question)).lower()), _WORDS.findall(_LEAD.sub("", _plain(answer)).lower())
    if not q or not a:
        return -1, -1, -1
    if q == a:
        return 1, 1, 1
    both = sum((Counter(q) & Counter(a)).values())
    words = 1 if both >= 0.85 * max(len(q), len(a)) else -1
    if len(a) > 2 * len(q) or len(q) > 2 * len(a):
        return -1, words, -1
    # The ratio counts words that match in order, so it can't be above that of the words at
    # all: only pairs that could reach the bound are aligned.
    bound = 2 * both / (len(q) + len(a)) >= 0.85
    order = 1 if bound and SequenceMatcher(None, q, a, autojunk=False).ratio() >= 0.85 else -1
    return 0 if words == 1 else -1, words, order


def refusal_votes(answer: str | None) -> tuple[int, int, int, int]:
    text = prose(answer).replace("’", "'")
    value = content_value(answer)
    acts = isinstance(value, dict) and (has_content(value.get("tool_calls")) or has_content(value.get("final_answer")))
    found = bool(_FINDINGS.search(value)) if isinstance(value, str) else acts
    vote = lambda x: 1 if x else -1
    return vote(_DECLINES.search(text)), vote(_OPENER.search(text)), 1 if _DEFERS.search(text) else 0, vote(not found and len(_TOOTH.findall(text)) <= 1)


def _features(text: str) -> Iterator[str]:
    """The words of a text and their letter triples."""
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        yield w
        p = f"<{w}>"
        for i in range(len(p) - 2):
            yield p[i : i + 3]


#: Commonest words and triples that the language table holds: bounds what every worker gets.
TABLE_FEATURES = 50_000
#: Counts that a task holds before it passes them on: bounds its memory only.
HELD_COUNTS = 200_000


def language_counts(texts: DataFrame, text: str) -> DataFrame:
    """feature, lang, n over all texts, whose languages their own function words tell; texts
    that these leave open are not counted. Tasks add up before anything is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        flush = lambda: pd.DataFrame([(f, x, n) for (f, x), n in held.items()], columns=["feature", "lang", "n"])
        for b in batches:
            for t in b["_t"]:
                said = prose(t)
                lang = top_language(function_word_scores(said), 1.5)
                if lang:
                    held.update((f, lang) for f in _features(said))
            if len(held) > HELD_COUNTS:
                yield flush()
                held.clear()
        yield flush()

    return texts.select(F.col(text).alias("_t")).mapInPandas(run, "feature string, lang string, n long").groupBy("feature", "lang").agg(F.sum("n").alias("n"))


def corpus_language(texts: DataFrame, text: str, most: int = TABLE_FEATURES) -> CorpusLanguage:
    """The table of the commonest features; their counts, and the totals, cover all texts."""
    counts = cut_lineage(language_counts(texts, text))
    total = {r[0]: (r[1], r[2]) for r in counts.groupBy("lang").agg(F.sum("n"), F.count("*")).collect()}  # nine rows
    kinds = counts.select("feature").distinct().count()
    per = counts.groupBy("feature").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("lang", F.col("n").alias("k")))).alias("by"))
    rows = per.orderBy(F.col("n").desc(), "feature").limit(most).select("feature", "by").collect()  # a top-k: the model's vocabulary
    return CorpusLanguage({r["feature"]: r["by"] for r in rows}, {k: v[0] for k, v in total.items()}, kinds)


class CorpusLanguage:
    """Naive Bayes over words and their letter triples."""

    def __init__(self, counts: dict[str, dict[str, int]], total: dict[str, int], kinds: int) -> None:
        self.langs = sorted(FUNCTION_WORDS)
        whole = np.array([total.get(x, 0) for x in self.langs], np.float64)
        size = whole + 0.2 * (kinds + 1)
        self.table = {f: np.log((np.array([by.get(x, 0) for x in self.langs], np.float64) + 0.2) / size).astype(np.float32) for f, by in counts.items()}
        self.seen = whole > 0

    def guess(self, text: str, lead: float = 4.0) -> str | None:
        hits = [self.table[f] for f in _features(text) if f in self.table]
        if len(hits) < 6:
            return None
        s = np.sum(hits, axis=0)
        s[~self.seen] = -np.inf
        a, b = np.sort(s)[::-1][:2]
        return self.langs[int(np.argmax(s))] if a - b >= lead else None


def language_votes(question: str, answer: str, corpus: CorpusLanguage) -> tuple[int, int, int]:
    def vote(a: str | None, b: str | None) -> int:
        return 0 if a is None or b is None else 1 if a != b else -1

    return (
        vote(top_language(function_word_scores(question), 1.0), top_language(function_word_scores(answer), 1.5)),
        vote(top_language(sign_scores(question), 3.0), top_language(sign_scores(answer), 3.0)),
        vote(corpus.guess(question), corpus.guess(answer)),
    )


def message_pairs(df: DataFrame, key: str, messages: str) -> DataFrame:
    """key, question_pos, question, answered, answer for every user message.

    The answer is the message directly after it if that is an assistant's. Roles are
    compared without case and outer blanks; null messages keep their places.
    """
    role = lambda m: F.lower(F.trim(m["role"]))
    m = F.col("m")
    one = F.transform(m, lambda x, i: F.struct(i.alias("question_pos"), (role(x) == "user").alias("user"), x["content"].alias("question"), F.coalesce(role(F.get(m, i + 1)) == "assistant", F.lit(False)).alias("answered"), F.get(m, i + 1)["content"].alias("answer")))
    rows = df.where(F.col(key).isNotNull() & F.col(messages).isNotNull()).select(key, F.col(messages).alias("m")).select(key, F.explode(F.filter(one, lambda x: F.coalesce(x["user"], F.lit(False)))).alias("p"))
    return rows.select(key, "p.question_pos", "p.question", "p.answered", F.when(F.col("p.answered"), F.col("p.answer")).alias("answer")).distinct()


def votes(pairs: DataFrame, key: str, judged: DataFrame) -> DataFrame:
    """key, question_pos and, for each defect, its functions' votes as text like '1,-1,0'.

    The functions for 'empty' and 'truncated' look for different signs, so one that
    doesn't fire abstains. judged: key, message_pos, shape, cut of the stored texts.
    """
    corpus = corpus_language(pairs.where("question_pos >= 0").select(F.explode(F.array("question", "answer")).alias("text")).where("text is not null"), "text")
    names = ["empty", "refusal", "copy", "other_language"]

    @F.pandas_udf(", ".join(f"{n} string" for n in names))
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for at, question, answered, answer in batches:
            rows = []
            for pos, q, there, a in zip(at.tolist(), question.tolist(), answered.tolist(), answer.tolist()):
                text = (a or "").translate(_ZERO).strip()
                blank = there and not text
                shell = there and bool(text) and not has_content(content_value(a))
                empty = tuple(int(x) for x in (not there, blank, shell))
                if pos < 0 or 1 in empty:
                    rows.append((empty, (-1, -1, 0, -1), (-1, -1, -1), (0, 0, 0)))
                else:
                    rows.append((empty, refusal_votes(a), copy_votes(q, a), language_votes(prose(q), prose(a), corpus)))
            yield pd.DataFrame([[",".join(map(str, v)) for v in r] for r in rows], columns=names)

    j = judged.select(F.col(key).alias("_k"), (F.col("message_pos") - 1).alias("_p"), "shape", "cut").distinct()
    joined = pairs.join(j, (F.col(key) == F.col("_k")) & (F.col("question_pos") == F.col("_p")) & F.col("answered") & (F.col("question_pos") >= 0), "left")
    sign = lambda c: F.when(F.coalesce(c, F.lit(False)), F.lit("1")).otherwise(F.lit("0"))
    cut = F.concat_ws(",", sign(F.col("shape") == "marked"), sign(F.col("shape") == "open"), sign(F.col("cut") & F.col("shape").isin("dangling", "word")))
    got = joined.select(key, "question_pos", cut.alias("truncated"), run("question_pos", "question", "answered", "answer").alias("v"))
    return got.select(key, "question_pos", "truncated", "v.*")


def defects(pairs: DataFrame, key: str, judged: DataFrame, cutoffs: dict[str, float] | None = None) -> DataFrame:
    """key, question_pos, defect, posterior: every defect above its cutoff for which a
    function votes, so a pair may have several rows. Pairs without defects give none; no pairs, no rows."""
    cutoffs = {**CUTOFFS, **(cutoffs or {})}
    v = cut_lineage(votes(pairs, key, judged))
    names = list(DEFECTS)
    long = v.select(F.explode(F.array(*[F.struct(F.lit(n).alias("d"), F.col(n).alias("p")) for n in names])).alias("x")).groupBy("x.d", "x.p").count()
    patterns: dict[str, dict[tuple[int, ...], int]] = {n: {} for n in names}
    for d, p, n in long.collect():  # at most 3^k patterns a defect
        patterns[d][tuple(map(int, p.split(",")))] = n
    found = []
    for d in names:
        posterior = fit(patterns[d], DEFECTS[d], PRIORS[d])
        table = [F.lit(x) for k, p in posterior.items() if p >= cutoffs[d] and 1 in k for x in (",".join(map(str, k)), p)]
        if table:
            found.append(F.struct(F.lit(d).alias("defect"), F.create_map(*table)[F.col(d)].alias("posterior")))
    if not found:
        return v.where("false").select(key, "question_pos", F.lit("").alias("defect"), F.lit(0.0).alias("posterior"))
    rows = v.select(key, "question_pos", F.explode(F.filter(F.array(*found), lambda x: x["posterior"].isNotNull())).alias("x"))
    return rows.select(key, "question_pos", "x.defect", "x.posterior")


def main_defect(found: DataFrame, key: str) -> DataFrame:
    """One defect a pair: the first in the order of DEFECTS, as the earlier ones leave
    nothing for the later to be judged by."""
    order = F.array_position(F.array(*[F.lit(d) for d in DEFECTS]), F.col("defect"))
    return found.groupBy(key, "question_pos").agg(F.min_by("defect", order).alias("defect"))


def final_answers(df: DataFrame, key: str, answers: str) -> DataFrame:
    """The final answer of each record as a pair of the place -1, without a question: its
    diagnoses, or no answer if none of its entries has a non-blank one. A record that is
    repeated with other answers has a pair for each."""
    real = F.filter(answers, lambda x: F.coalesce(F.length(F.regexp_replace(x["diagnosis"], r"[\s\p{Z}​﻿]", "")) > 0, F.lit(False)))
    told = F.array_join(F.transform(real, lambda x: x["diagnosis"]), "; ")
    there = F.coalesce(F.size(real), F.lit(0)) > 0
    rows = df.where(F.col(key).isNotNull()).select(key, F.lit(-1).alias("question_pos"), F.lit(None).cast("string").alias("question"), there.alias("answered"), F.when(there, told).alias("answer"))
    return rows.distinct()
