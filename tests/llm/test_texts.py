import base64
import random
from collections import Counter

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from radiolake.llm import bpe, gru, labelmodel, language, mixing, pairs, truncation

PATH = f"{bpe.TOKENIZERS}/{bpe.RANKS}"


@pytest.fixture(scope="module")
def public():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_match_the_public_encoder(public):
    b = bpe.load(PATH)
    rnd = random.Random(1)
    alphabet = "abcdeettaainoos  lrhTHE\n\t=-_.,:;aaaéüñжи漢<|>0123456789'​🦷"
    texts = ["", None, " ", "<|endoftext|>", "a" * 3000, " " * 500, "\n" * 70 + "x", "don't WE'LL", "aaaaabaaaab" * 50]
    texts += ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(300))) for _ in range(500)]
    texts += ["".join(rnd.choice("ab") * rnd.randrange(1, 30) for _ in range(30)) for _ in range(100)]
    for t, ids in zip(texts, b.encode_batch(texts)):
        assert list(ids) == (public.encode_ordinary(t) if t else [])


def test_encoding_keeps_every_row(spark):
    df = spark.createDataFrame([(1, "hello", "s"), (2, None, None), (3, "", "s"), (3, "", "s"), (4, "x " * 20_000, "s")], "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], len(r["ids"])) for r in bpe.encode(df.select("doc_id", "text"), "doc_id", "text").collect())
    assert [g[0] for g in got] == [1, 2, 3, 3, 4] and [g[1] > 0 for g in got] == [True, False, False, False, True]
    assert bpe.encode(df.where("false"), "doc_id", "text").count() == 0


def test_known_words_are_only_a_memory(monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 3)
    b, want = bpe.Bpe(PATH), bpe.load(PATH)
    for t in ("one two three four five", "six one two", "seven"):
        assert list(b.encode_batch([t])[0]) == list(want.encode_batch([t])[0])


def tokens(spark, sizes):
    rows = [(i, s, list(range(i * 1000, i * 1000 + n))) for i, (s, n) in enumerate(sizes)]
    return spark.createDataFrame(rows, "doc long, src string, ids array<int>")


def test_packing_keeps_every_token_once(spark):
    t = tokens(spark, [("a", n) for n in (0, 1, 5, 40, 9, 3)] + [("b", 7), (None, 4)])
    got = mixing.blocks(mixing.pack(t, "doc", "src", "ids", 8), "doc", "src").collect()
    for s, total in (("a", 58), ("b", 7)):
        mine = sorted((r for r in got if r["src"] == s), key=lambda r: r["block_index"])
        assert [r["block_index"] for r in mine] == list(range(len(mine)))
        assert all(len(r["ids"]) == 8 for r in mine[:-1])
        flat = [i for r in mine for i in r["ids"]]
        assert len(flat) == total == len(set(flat))
        for doc in {i // 1000 for i in flat}:  # a document's tokens stay together and in order
            part = [i for i in flat if i // 1000 == doc]
            assert part == list(range(doc * 1000, doc * 1000 + len(part)))


def test_permutations():
    for n in (1, 2, 3, 17, 100, 1025):
        for salt in (0, 5):
            got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, salt))
            assert sorted(got.tolist()) == list(range(n))
    assert mixing.permuted(np.arange(100), np.full(100, 100), np.full(100, 1)).tolist() != mixing.permuted(np.arange(100), np.full(100, 100), np.full(100, 2)).tolist()


def test_shares_and_repeats(spark):
    t = tokens(spark, [("a", 97)] * 60 + [("b", 31)] * 20 + [("c", 64)] * 3 + [("unnamed", 50)] * 5)
    goal = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.15, 5), ("absent", 0.05, 9), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(t, "doc", "src", "ids", goal, block=16)
    rows = mixed.collect()
    uses = Counter((r["source"], r["block_index"]) for r in rows)
    assert max(v for (s, _), v in uses.items() if s == "a") == 1 and max(v for (s, _), v in uses.items() if s == "c") <= 5
    rep = {r["source"]: r for r in mixing.shares(mixed, goal).collect()}
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.15)):
        assert abs(rep[s]["reached_share"] - share / 0.95) < 0.03
    assert rep["absent"]["tokens"] == 0 and "unnamed" not in rep
    assert all(r["repeats_kept"] for r in mixing.kept(mixing.shares(mixed, goal), goal, 0.03).collect()) and all(r["share_kept"] for r in mixing.kept(mixing.shares(mixed, goal), goal, 0.03).collect())
    assert sorted((r["shard"], r["slot"]) for r in rows) == sorted((r["shard"], r["slot"]) for r in mixing.mix(t.repartition(5), "doc", "src", "ids", goal, block=16).collect())
    assert mixing.mix(t.where("false"), "doc", "src", "ids", goal).count() == 0


def test_plan():
    have, want = {"a": (10_000, 100), "b": (500, 5)}, {"a": (0.5, 1), "b": (0.5, 20), "c": (0.2, 1)}
    names, shares, slots = mixing.plan(have, want)
    assert names == ["a", "b"] and slots.tolist() == [100, 100] and shares.tolist() == [0.5, 0.5]
    assert mixing.plan(have, want, size=2000)[2].tolist() == [10, 10] and mixing.plan({}, want)[0] == []


def test_draws_are_multinomial_and_settle(spark):
    """Each shard's draw is its own; all together are put right to the last slot."""
    shares, wanted = np.array([0.6, 0.3, 0.1]), np.array([603, 297, 100])
    rows = mixing.draw(spark, shares, 1000, 5, shard_blocks=64).collect()
    by_shard, drawn = Counter(), np.zeros(3, np.int64)
    for r in sorted(rows, key=lambda r: (r["j"], r["shard"])):
        by_shard[r["shard"]] += r["n"]
        assert r["start"] == drawn[r["j"]]
        drawn[r["j"]] += r["n"]
    assert [by_shard[i] for i in range(16)] == [64] * 15 + [40] and all(drawn[r["j"]] == r["drawn"] for r in rows)
    j = np.repeat(np.arange(3), drawn)
    i = np.concatenate([np.arange(n) for n in drawn])
    to, number = mixing.settled(j, i, drawn, wanted)
    assert sorted(zip(to.tolist(), number.tolist())) == [(s, k) for s in range(3) for k in range(wanted[s])]
    assert (to != j).sum() == np.maximum(drawn - wanted, 0).sum() < 60


@pytest.mark.parametrize(
    "text, want",
    [
        ("All is well.", "stop"), ('{"a": [1, 2]}', "json"), ('{"a": [1, 2', "open"), ('{"a": "x', "open"), ('{"a": "x\\', "open"), ('{"a": "}"', "open"), ('{"a": "{[("}', "json"),
        ("The crop was…", "marked"), ("The cr [truncated]", "marked"), ("The cr <cut>", "marked"), ("The cr (more)", "marked"), ("The c[…]", "marked"), ("and then,", "dangling"),
        ("one finding only", "word"), ("plan abandoned (attempt 7)", "stop"), ("plan abandoned (att", "open"), ("```json\n{}", "open"), ("```json\n{}\n```", "json"), ("délai apr�", "open"),
        ("Result of a: {\"x\": 1} All well.", "stop"), ("He said “yes", "open"), ("He said “yes.”", "stop"), ("smile :) fine.", "stop"), ("„Ja“, sagte er.", "stop"), ("x &am", "open"), ("<p>ok</", "open"), ("Is it 5 < 6?", "stop"),
    ],
)
def test_shapes(text, want):
    assert truncation.shape(text) == want


def test_judged_by_the_corpus(spark):
    whole = [f"done: trace closed by the planner of lane {i % 4}" for i in range(40)] + ["done: one finding only"] * 20 + ["done"] * 20 + ["needs_tool"] * 20
    cut = ["done: trace closed by the pl", "done: trace closed by", "needs_too", "done: one finding o", "done: trace "]
    odd = [None, "", "   ", "​"]
    rows = [(i, "s", "status", t) for i, t in enumerate([*whole, *cut, *odd])]
    rows += [(1000 + i, "s", "message", "The worker is done with the one finding only by the end of it.") for i in range(30)]
    df = spark.createDataFrame(rows, "id long, source string, kind_of string, text string").withColumn("kind", F.lit("clash")).withColumn("shape", F.lit("clash"))
    got = {r["id"]: r["cut"] for r in truncation.judge(df, ["id", "kind_of"], "kind_of").collect()}
    assert {i for i, c in got.items() if c} == set(range(len(whole), len(whole) + len(cut)))
    assert len(got) == len(rows) - len(odd)
    assert truncation.judge(df.where("false"), ["id", "kind_of"], "kind_of").count() == 0


def brute_evidence(counts, asked, width):
    out = {}
    for a in asked:
        context, end = a[:width], a[width]
        mine = [(t, b, o) for *c, t, b, o in counts if tuple(c) == context]
        e, x = sum(b for t, b, _ in mine if t == end), sum(o for t, _, o in mine if t == end)
        x += sum(b + o for t, b, o in mine if t != end and t.startswith(end))
        out[a] = (e, x)
    return out


def test_evidence_against_brute_force(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abä") for _ in range(rnd.randrange(1, 7)))
    seen = {(rnd.choice("xy"), word()): (rnd.randrange(4), rnd.randrange(5)) for _ in range(300)}
    counts = [(c, t, b, o) for (c, t), (b, o) in seen.items()] + [("x", "a" * 50_000, 1, 1)]
    asked = list({(rnd.choice("xyz"), word()) for _ in range(120)} | {("x", "a"), ("x", "aa")})
    got = truncation._evidence(spark.createDataFrame(counts, "kind string, t3 string, bare long, other long"), spark.createDataFrame(asked, "kind string, t3 string"), ["kind"], 1).collect()
    want = brute_evidence(counts, asked, 1)
    have = {(r["kind"], r["t3"]): (r["e1"], r["x1"]) for r in got}
    assert have.keys() <= want.keys() and all(have.get(a, (0, 0)) == w for a, w in want.items())


def test_label_model_recovers_planted_labels():
    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.03
    fns = [labelmodel.Function("a", 0.9, 0.001), labelmodel.Function("b", 0.7, 0.02), labelmodel.Function("c", 0.8, 0.05)]
    votes = np.stack([np.where(rng.random(len(y)) < np.where(y, h, f), 1, -1) for h, f in ((0.95, 0.002), (0.6, 0.03), (0.7, 0.04))], 1)
    votes[rng.random(votes.shape) < 0.1] = 0
    patterns = Counter(map(tuple, votes.tolist()))
    post = labelmodel.fit(patterns, fns, 0.02)
    said = np.array([post[tuple(v)] > 0.5 for v in votes.tolist()])
    assert (said & y).sum() / said.sum() > 0.9 and (said & y).sum() / y.sum() > 0.85
    assert labelmodel.fit({}, fns, 0.02) == {}


Q = "Please describe what you see around 28 in this film."
GOOD = "Tooth 28 shows early enamel caries and the border of the crop is sharper than before. No treatment is needed at present."
PAIRS = [
    (Q, GOOD, None), (Q, "", "empty"), (Q, None, "empty"), (Q, "​", "empty"), (Q, '{"thought": "", "tool_calls": []}', "empty"), (Q, "```json\n```", "empty"), (Q, "[]", "empty"), (Q, "null", "empty"),
    (Q, '{"thought": "", "tool_calls": [{"tool": "denoise"}]}', None), (Q, "I'm sorry, but I can't help with reading this image.", "refusal"), (Q, '{"thought": "This request is outside what I may answer."}', "refusal"),
    (Q, "Sorry for the long trace: 28 is sound after all. The crop is fine and the box is good.", None), (Q, "I cannot see any lesion at 28; the apex is intact.", None), (Q, "The locator was not able to find 28, so I used the neighbour.", None),
    (Q, Q.upper(), "copy"), (Q, "> " + Q, "copy"), (Q, '{"thought": "please describe what you see around 28 in this film"}', "copy"), (Q, Q + " " + GOOD, None),
    (Q, "An Zahn 28 zeigt sich eine kleine Aufhellung, und eine Kontrolle ist sinnvoll. Bei 27 wurde nichts gefunden.", "other_language"), ("Wie beurteilst du Zahn 28 auf dieser Aufnahme?", "An Zahn 28 zeigt sich eine kleine Aufhellung. Findings: 28 Deep Caries", None),
    (Q, "Tooth 28 shows early enamel caries and the bor", "truncated"), (Q, '{"thought": "Tooth 28 shows early', "truncated"),
]


def test_pairs_by_defect(spark):
    rows, n = [], 0
    for k in range(30):
        rows.append((n := n + 1, [("User", Q), ("assistant", GOOD.replace("28", str(11 + k)) + (" Findings: 28 Deep Caries" if k % 3 == 0 else ""))]))
        rows.append((n := n + 1, [("user", "Wie beurteilst du Zahn 28 auf dieser Aufnahme und warum?"), ("assistant", "An Zahn 28 zeigt sich eine Aufhellung, und die Kontrolle ist sinnvoll. Bei 27 wurde nichts gefunden.")]))
    first = n
    for q, a, _ in PAIRS:
        rows.append((n := n + 1, [("system", "s"), ("user ", q), (" ASSISTANT", a)]))
    rows += [(9001, [("user", Q)]), (9002, [("user", Q), ("user", Q), ("assistant", GOOD)]), (9003, [("user", Q), None, ("assistant", GOOD)]), (9004, None), (9005, []), (9002, [("user", Q), ("user", Q), ("assistant", GOOD)])]
    df = spark.createDataFrame(rows, "k long, m array<struct<role string, content string>>")
    texts = df.select("k", F.posexplode("m").alias("message_pos", "x")).select("k", "message_pos", F.lit("s").alias("source"), F.lit("m").alias("t"), F.col("x.content").alias("text")).distinct()
    judged = truncation.judge(texts, ["k", "message_pos", "t"], "t")
    p = pairs.message_pairs(df, "k", "m")
    got = {(r["k"], r["question_pos"]): r["defect"] for r in pairs.main_defect(pairs.defects(p, "k", judged), "k").collect()}
    want = {(first + 1 + i, 1): d for i, (_, _, d) in enumerate(PAIRS) if d} | {(9001, 0): "empty", (9002, 0): "empty", (9003, 0): "empty"}
    assert got == want
    assert pairs.defects(p.where("false"), "k", judged).count() == 0


def test_final_answers(spark):
    a = "array<struct<diagnosis string>>"
    df = spark.createDataFrame([(1, None), (2, []), (3, [None]), (4, [(" ",), (None,)]), (5, [("",), ("x",)]), (None, None), (1, None), (6, [("y",)])], f"k long, f {a}")
    rows = pairs.final_answers(df, "k", "f").collect()
    assert {(r["k"], r["question_pos"], r["answered"], r["answer"]) for r in rows} == {(k, -1, False, None) for k in (1, 2, 3, 4)} | {(5, -1, True, "x"), (6, -1, True, "y")}
    judged = spark.createDataFrame([(5, 0, "open", True)], "k long, message_pos int, shape string, cut boolean")
    found = pairs.main_defect(pairs.defects(pairs.final_answers(df, "k", "f"), "k", judged), "k").collect()
    assert {(r["k"], r["question_pos"], r["defect"]) for r in found} == {(k, -1, "empty") for k in (1, 2, 3, 4)}


def test_copy_votes_against_alignment():
    from difflib import SequenceMatcher

    rnd = random.Random(5)
    for _ in range(300):
        q = [rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 12))]
        a = [x for x in q if rnd.random() < 0.9] + [rnd.choice("abcdefgh") for _ in range(rnd.randrange(3))]
        if rnd.random() < 0.3:
            rnd.shuffle(a)
        if a and len(a) <= 2 * len(q) and len(q) <= 2 * len(a):
            assert pairs.copy_votes(" ".join(q), " ".join(a))[2] == (1 if SequenceMatcher(None, q, a, autojunk=False).ratio() >= 0.85 else -1)
    assert pairs.copy_votes("Why?", "why") == (1, 1, 1) and pairs.copy_votes("?", "x") == (-1, -1, -1)


def test_language_counts_cover_every_text(spark, monkeypatch):
    texts = ["The crop is in the view of the reader.", "Der Rahmen ist nicht in der Mitte, und das ist gut."] * 40 + [None, "", "xyz"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    want = Counter()
    for t in texts:
        lang = pairs.top_language(pairs.function_word_scores(pairs.prose(t)), 1.5)
        want.update((f, lang) for f in pairs._features(pairs.prose(t)) if lang)
    monkeypatch.setattr(pairs, "HELD_COUNTS", 20)
    assert {(r["feature"], r["lang"]): r["n"] for r in pairs.language_counts(df, "t").collect()} == want
    c = pairs.corpus_language(df, "t")
    assert c.guess("the crop is in the view") == "en" and c.guess("der Rahmen ist nicht gut") == "de" and c.guess("x") is None


def test_sentences_by_their_company(spark):
    """A sentence that its documents' language speaks against is put right, a rare one is not."""
    seg = lambda s, lang: (s, lang, 0.99, 10)
    rows = [(i, "es", 0.9, [seg("Comparado con 12 .", "pt" if i % 2 else "es"), seg("Uno.", "es")]) for i in range(8)] + [(90, "pt", 0.9, [seg("Comparado con 7 .", "pt")]), (91, "es", 0.9, [seg("Raro.", "pt"), seg("Uno.", "es"), seg("Uno.", "es")]), (92, None, 0.0, [])]
    df = spark.createDataFrame(rows, "k long, main string, confidence double, segs array<struct<segment string, lang string, confidence double, letters int>>")
    got = {r["k"]: (r["main"], [s["lang"] for s in r["segs"]]) for r in language.by_company(df, "k").collect()}
    assert all(got[i] == ("es", ["es", "es"]) for i in range(8)) and got[90] == ("es", ["es"]) and got[91] == ("es", ["pt", "es", "es"]) and got[92] == (None, [])


def test_gradients():
    net = gru.ByteTagger(3, 4, 0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask = gru.batch([b"abc", b"defgh", b"a"])
    y = np.array([0, 2, 1])
    _, grads = net.gradients(x, mask, y)
    assert grads.keys() == net.p.keys()
    for k, g in grads.items():
        for at in [np.unravel_index(i, g.shape) for i in np.abs(g).ravel().argsort()[-3:]]:
            net.p[k][at] += 1e-4
            up = net.gradients(x, mask, y)[0]
            net.p[k][at] -= 2e-4
            down = net.gradients(x, mask, y)[0]
            net.p[k][at] += 1e-4
            assert abs((up - down) / 2e-4 - g[at]) < 1e-5, k


def test_padding_and_windows_change_nothing():
    net = gru.ByteTagger(4, 8, 3)
    alone = [net.pooled([s])[0] for s in (b"one", b"a much longer text here")]
    assert np.allclose(net.pooled([b"one", b"a much longer text here"]), alone, atol=1e-5)
    assert net.pooled([b"x" * 1000, b""]).shape == (2, 4)
    again = gru.ByteTagger.from_weights(net.weights())
    assert np.allclose(again.pooled([b"one"]), net.pooled([b"one"]))


SENTENCES = {
    "en": ["The crop is mostly gum and only the edge is in view.", "The reader marked the region first and the molars afterwards.", "Please compare it with the older film before the next run."],
    "de": ["Der Rahmen um den Zahn ist etwa dreißig Pixel breit.", "Bitte vor dem nächsten Lauf die Aufnahme noch einmal prüfen.", "Eine Antwort ohne Werkzeug gilt nicht als Beispiel."],
    "ru": ["На этом снимке передний отдел виден плохо.", "Ответ без инструмента не считается примером.", "Эта заметка заменяет написанную ранее."],
}


def test_held_out_accuracy_and_defects(spark, monkeypatch):
    monkeypatch.setattr(language, "STEPS", (60, 60))  # three languages are learnt sooner
    rnd = random.Random(0)
    docs = []
    for i in range(240):
        lang = rnd.choice(list(SENTENCES))
        docs.append((i, rnd.choice([lang, lang.upper(), {"en": "English", "de": "deu", "ru": "rus"}[lang]]), " ".join(rnd.choice(SENTENCES[lang]).replace("the", "the", 1) + f" {rnd.randrange(99)}." for _ in range(4))))
    fit = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    w = language.fit(fit, "text", "lang", "doc_id", per_language=60)
    two = SENTENCES["en"][0] + " " + SENTENCES["en"][1] + " " + SENTENCES["de"][0]
    cases = [
        (1, "en-US", SENTENCES["en"][2]), (2, None, SENTENCES["de"][1]), (3, " ", SENTENCES["ru"][1]), (4, "de_AT", SENTENCES["en"][0]), (5, "en", two), (6, "zxx", "12:3 44:x 18:-"), (7, None, None), (8, "und", ""),
        (9, "sv", SENTENCES["de"][2]), (10, "English", '{"thought": "' + SENTENCES["en"][1] + '", "tool_calls": [{"tool": "zoom_crop"}]}'), (11, "en", "\n".join([two] * 400)), (2, None, SENTENCES["de"][1]),
    ]
    df = spark.createDataFrame(cases, "doc_id long, label string, text string")
    lab = language.label_documents(df, "doc_id", "text", ["label"], w)
    got = {tuple(r) for r in language.label_defects(lab, "doc_id", "label").collect()}
    assert got == {(2, "missing", "de"), (3, "missing", "ru"), (4, "wrong", "en"), (5, "mixed", "de"), (9, "wrong", "de"), (11, "mixed", "de")}
    assert language.label_documents(df.where("false"), "doc_id", "text", ["label"], w).count() == 0
    assert language.fit(fit.where("false"), "text", "lang", "doc_id") is None
    assert language.label_documents(df, "doc_id", "text", ["label"], None).where("main is not null").count() == 0


def test_segments():
    assert language.segments('Before it all. {"thought": "Broken here.", {\nAnd prose goes on.') == ["Before it all.", "Broken here.", "And prose goes on."]
    assert language.segments(None) == [] and language.segments("47 x 12:3") == []
    assert language.segments("```\ncode here inside\n```\nA plain line of text.") == ["A plain line of text."]
    assert language.segments('{"thought": "One sentence here.\\nTwo sentences here.", "tool_calls": []}') == ["One sentence here.", "Two sentences here."]
    assert language.segments("<p>First one here.</p> <|endoftext|> Second one, then?") == ["First one here.", "Second one, then?"]
