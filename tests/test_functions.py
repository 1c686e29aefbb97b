import json
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from radiolake.functions import budget, fdi, geometry, images, text


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def lit_box(*v):
    return geometry.Box(*[F.lit(float(x)) for x in v])


def test_tooth_codes(spark):
    pairs = [(3, 6), (1, 1), (4, 8), (5, 1), (1, 9), (9, 1), (2, 0), (None, 1)]
    df = spark.createDataFrame(pairs, "q int, p int")
    q, p = F.col("q"), F.col("p")
    got = [tuple(r) for r in df.select(fdi.code(q, p), fdi.label(q, p), fdi.detector_class(q, p), fdi.label_class(q, p)).collect()]
    assert got == [(36, "36", 22, 21), (11, "11", 1, 0), (48, "48", 32, 31)] + [(None, None, None, None)] * 5
    r = one(spark, *fdi.decode(F.lit(36)), *fdi.decode(F.lit("21")), *fdi.decode(F.lit(59)), *fdi.decode(F.lit("x")), fdi.name(F.lit(3), F.lit(6)))
    assert tuple(r) == (3, 6, 2, 1, None, None, None, None, "Mandibular Left (Lower Left) First Molar (FDI #36)")


def test_strict_codes_raise(spark):
    with pytest.raises(PySparkException):
        spark.range(1).select(fdi.code(F.lit(5), F.lit(1), strict=True)).collect()
    with pytest.raises(PySparkException):
        spark.range(1).select(fdi.flipped(F.lit(5), strict=True)).collect()
    assert tuple(one(spark, *[fdi.flipped(F.lit(i)) for i in (1, 2, 3, 4, 5)])) == (2, 1, 4, 3, 5)


def test_overlap(spark):
    a = lit_box(0, 0, 10, 10)
    r = one(spark, geometry.iou(a, a), geometry.iou(a, lit_box(20, 20, 5, 5)), geometry.iou(a, lit_box(5, 0, 10, 10)), geometry.iou(a, lit_box(0, 0, 10, 30)), geometry.iou(lit_box(0, 0, 0, 0), lit_box(0, 0, 0, 0)))
    assert np.allclose(tuple(r), (1, 0, 1 / 3, 1 / 3, 0))


def test_windows(spark):
    w, h = F.lit(1024), F.lit(512)
    z = geometry.zoomed(lit_box(100, 100, 50, 50), w, h)
    assert tuple(one(spark, z.w - z.x, z.h - z.y)) == (150, 150)
    n = geometry.nudged(lit_box(1000, 500, 100, 100), w, h, F.lit(0.0), F.lit(0.0), F.lit(0.01))
    assert tuple(one(spark, *n)) == (1014.0, 502.0, 10.0, 10.0)
    bad = geometry.nudged(lit_box(1, 1, 0, 5), w, h, F.lit(0.0), F.lit(0.0), F.lit(1.0))
    assert tuple(one(spark, *bad)) == (None,) * 4
    m = geometry.mirrored(lit_box(100, 200, 50, 100), w, h, F.lit(1))
    assert tuple(one(spark, *m)) == (874, 200, 924, 256)
    assert tuple(one(spark, *geometry.mirrored(lit_box(100, 300, 50, 100), w, h, F.lit(2)))) == (None,) * 4
    s, left, top = geometry.letterbox(F.lit(1000), F.lit(1000), 1024, 512)
    assert tuple(one(spark, s, left, top)) == (0.512, 256, 0)
    c = geometry.from_centre(lit_box(50, 50, 20, 20), F.lit(0), F.lit(0), w, h)
    assert tuple(one(spark, *c)) == (38.0, 38.0, 24.0, 24.0)


def test_perturbation_shares(spark):
    df = spark.range(20_000).select((F.rand(1)).alias("a"), F.rand(2).alias("b"))
    tier, shift = geometry.perturbation(F.col("a"), F.col("b"))
    rows = {r["t"]: r for r in df.select(tier.alias("t"), F.abs(shift).alias("s")).groupBy("t").agg(F.count("*").alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi")).collect()}
    assert abs(rows["big"]["n"] / 20_000 - 0.3) < 0.02 and abs(rows["small"]["n"] / 20_000 - 0.25) < 0.02
    assert 0.45 <= rows["big"]["lo"] and rows["big"]["hi"] <= 0.75 and 0.12 <= rows["small"]["lo"] and rows["small"]["hi"] <= 0.28


def test_budgets(spark):
    r = one(spark, budget.turn_budget(F.lit(3), 6, 30, 4), budget.open_turn_budget(F.lit(20), 12), budget.memory(F.lit(4), F.lit(2048))["estimated_peak_gb"], *budget.call_budget(F.lit(10), 3, 20))
    assert tuple(r) == (7, 23, 9.4, 60, 3)


TOOL = {"tool_calls": [{"tool": "zoom_crop", "args": {"bbox": [1, 2]}}]}


@pytest.mark.parametrize(
    "reply, want",
    [
        (json.dumps(TOOL), TOOL),
        ('{"tool": "a", "args": {"x": 1}}', {"tool_calls": [{"tool": "a", "args": {"x": 1}}]}),
        ('{"tool": "a"}', {"tool_calls": [{"tool": "a", "args": {}}]}),
        (f"Sure:\n```json\n{json.dumps(TOOL)}\n```", TOOL),
        (f"text {json.dumps(TOOL)} more text", TOOL),
        ('{"final_answer": [{"quadrant": 1},],}', {"final_answer": [{"quadrant": 1}]}),
        ('<think>{"tool": "decoy"}</think>{"tool": "real"}', {"tool_calls": [{"tool": "real", "args": {}}]}),
        ('{"tool": "first"} {"final_answer": 2}', {"final_answer": 2}),
        ('{"thought": "x", "final_answer": {"quadrant": 3, "confidence": 0.', {"thought": "x", "final_answer": {"quadrant": 3, "confidence": 0}}),
        ('{"final_answer": {"diagnosis": "Car', {"final_answer": {"diagnosis": "Car"}}),
        ('{"final_answer": [{"diagnosis": "Car', {"final_answer": [{"diagnosis": "Car"}]}),
        ('{"tool_calls": [{"tool": "a"}, {"tool": "b", "args": {"x": tru', {"tool_calls": [{"tool": "a"}, {"tool": "b", "args": {"x": None}}]}),
        ('{"final_answer": 1, "note": "half an escape \\u00', {"final_answer": 1, "note": "half an escape "}),
        ('{"final_answer": 1, "not', {"final_answer": 1, "not": None}),
        ('{"final_answer": 1, "note"', {"final_answer": 1, "note": None}),
        ('{"final_answer": 1, "note":', {"final_answer": 1, "note": None}),
        ('{"final_answer": 1,', {"final_answer": 1}),
        ('He said "no {" and left. {"final_answer": "a, ]"}', None),
        ('It\'s "fine": {"final_answer": "a, ] }"} so', {"final_answer": "a, ] }"}),
        ('{"final_answer": "x,]",}', {"final_answer": "x,]"}),
        ('{"thought": "{", "tool": "a", "args": null}', {"thought": "{", "tool_calls": [{"tool": "a", "args": {}}]}),
        ("no json here", None),
        ("", None),
        (None, None),
        ('{"other": 1}', None),
        ("[1, 2]", None),
    ],
)
def test_action(reply, want):
    assert text.action(reply) == want


def test_action_never_fails():
    rnd = random.Random(3)
    whole = json.dumps({"thought": 'a "quoted" {brace}', "tool_calls": [{"tool": "t", "args": {"b": [1, 2.5]}}], "note": None})
    for _ in range(500):
        cut = whole[: rnd.randrange(len(whole) + 1)]
        got = text.action(rnd.choice(["", "x ", "```json\n", "<think>"]) + cut)
        assert got is None or "tool_calls" in got


def test_action_column(spark):
    """The column gives what the scanner gives, also where a reply never leaves the JVM."""
    replies = [
        '{"tool": "a"}', None, "x", "", json.dumps(TOOL), " " + json.dumps(TOOL) + "\n", json.dumps(TOOL) + " more", json.dumps(TOOL) + json.dumps({"final_answer": 1}), '{"final_answer": 1}, {"final_answer": 2}',
        '{"final_answer": null}', '{"tool_calls": [], "tool": "x"}', '{"final_answer": 1,}', "<think>a</think>" + json.dumps(TOOL), "```" + json.dumps(TOOL) + "```", '{"final_answer": {"a": "<think>"}}', '[{"final_answer": 1}]', '{"a": {"final_answer": 1}}',
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string")
    got = {r["i"]: r["a"] for r in df.select("i", text.action_json(F.col("r")).alias("a")).collect()}
    assert {i: a and json.loads(a) for i, a in got.items()} == {i: text.action(r) for i, r in enumerate(replies)}
    clean = {r["i"] for r in df.where(text.is_clean_action(F.col("r"))).collect()}
    assert clean == {4, 5, 9}


def test_small_predicates(spark):
    r = one(spark, text.usable_key(F.lit("your_key")), text.usable_key(F.lit("k1")), text.usable_key(F.lit(None).cast("string")), text.without_trailing_commas(F.lit("[1,]")))
    assert tuple(r) == (False, True, False, "[1]")
    told = {"HTTP 503 no": True, "503": True, " 500": True, "HTTP 503": False, "HTTP 503.": True, "HTTP 429 x": False, "model UNAVAILABLE": True, "Internal Server Error": True, "internal": False, "timeout": False, "501 x": False, "": False, None: False}
    df = spark.createDataFrame([(t,) for t in told], "t string")
    assert {r[0]: r[1] for r in df.select("t", text.server_error(F.col("t"))).collect()} == told
    assert one(spark, text.server_error(F.lit("x"), F.lit(503)))[0] is True


def test_tooth_names(spark):
    name = lambda q, p: one(spark, fdi.name(F.lit(q), F.lit(p)))[0]
    assert name(1, 1) == "Maxillary Right (Upper Right) Central Incisor (FDI #11)"
    assert name(5, 9) == "Quadrant 5 Tooth 9 (FDI #??)"
    for told, want in (("38", (3, 8, None)), ("3", (None, None, "not two digits: 3")), ("x1", (None, None, "not a number: x1")), ("59", (None, None, "no such tooth: 59"))):
        assert tuple(one(spark, *fdi.read_number(F.lit(told)))) == want


def test_pixels(spark):
    grey = np.tile(np.arange(256, dtype=np.uint8), (120, 1))
    out = images.window_level(grey, "bone")
    assert out.min() == 0 and out.max() == 255 and out.dtype == np.uint8 and (np.diff(out[0].astype(int)) >= 0).all()
    assert (images.window_level(grey, "nothing") == out).all()
    assert (images.more_contrast(grey, 1.0) == grey).all()
    assert images.side_by_side(grey, grey[:50]).shape == (120, 522)
    assert images.cropped(grey, (-5, 10, 20, 30)).shape == (20, 20)
    assert images.quality(grey) == (True, "ok") and not images.quality(grey[:50])[0] and not images.quality(np.zeros((200, 200), np.uint8))[0]
    step = np.zeros((200, 200), np.uint8)
    step[100:] = 200
    assert images.quality(step)[1].startswith("brightness")
    df = spark.createDataFrame([(bytearray(grey.tobytes()), 256), (None, 256), (bytearray(b"abc"), 2)], "b binary, w int")
    assert [r[0] for r in df.select(images.quality_gate("b", "w")["ok"]).collect()] == [True, False, False]
    assert bytes(df.select(images.windowed("bone")("b")).first()[0]) == out.tobytes()


def test_headers(spark):
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big") + b"\x08\x06"
    gif = b"GIF89a" + (20).to_bytes(2, "little") + (30).to_bytes(2, "little")
    bmp = b"BM" + b"\0" * 16 + (70).to_bytes(4, "little") + (80).to_bytes(4, "little") + b"\x01\0\x18\0"
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc2\0\x11\x08" + (9).to_bytes(2, "big") + (8).to_bytes(2, "big") + b"\x01" + b"\0" * 9
    film = images.png(images.synthetic(160, 120, 3))
    rows = [(i, bytearray(x)) for i, x in enumerate((png, gif, bmp, jpeg, film, b"\xff\xd8\xff\xe0", png[:20], b"none", b""))] + [(9, None)]
    df = spark.createDataFrame(rows, "i int, c binary")
    none = (None, None, None, None)
    want = [("png", 640, 480, "RGBA"), ("gif", 20, 30, "P"), ("bmp", 70, 80, "RGB"), ("jpeg", 8, 9, "L"), ("png", 160, 120, "L"), none, none, none, none, none]
    assert [tuple(r["h"]) for r in df.select("i", images.header(F.col("c")).alias("h")).orderBy("i").collect()] == want
    assert tuple(one(spark, *images.denoise_parameters(F.lit(0.5)))) == (15, 110, 9)


def test_pixel_columns(spark):
    grey = np.arange(64, dtype=np.uint8).reshape(8, 8)
    df = spark.createDataFrame([(bytearray(grey.tobytes()), 8), (None, 8), (bytearray(b"abc"), 2)], "b binary, w int")
    box = [F.lit(x) for x in (2, 1, 6, 3)]
    got = df.select(images.crops()("b", "w", *box).alias("c"), images.contrasted(1.0)("b", "w").alias("k"), images.comparisons(1)("b", "w", *box, *box).alias("p")).collect()
    assert [r and bytes(r) for r in got[0]] == [grey[1:3, 2:6].tobytes(), grey.tobytes(), images.side_by_side(grey[1:3, 2:6], grey[1:3, 2:6], 1).tobytes()]
    assert all(x is None for r in got[1:] for x in r)
    assert (images.synthetic(64, 64, 1) == images.synthetic(64, 64, 1)).all() and images.quality(images.synthetic(256, 128))[0]


def test_context_and_paths(spark):
    m = [("user", "see <Image>"), ("tool", "<Image> a"), None, ("tool", None), ("tool", "<Image> b"), ("tool", "<Image> c")]
    df = spark.createDataFrame([(m,), ([],), (None,)], "m array<struct<role string, content string>>")
    got = [r[0] and [x and x["content"] for x in r[0]] for r in df.select(budget.trimmed(F.col("m"), 10, 1, "-")).collect()]
    assert got == [["see <Image>", "-", None, None, "-", "<Image> c"], [], None]
    assert df.select(budget.trimmed(F.col("m"), 100_000, 1, "-")).first()[0][1]["content"] == "<Image> a"
    turns = spark.createDataFrame([([("a",), None, (None,), ("b",)],), (None,)], "t array<struct<raw_output string>>")
    assert [r[0] for r in turns.select(text.reasoning(F.col("t"))).collect()] == ["a\n\nb", ""]
