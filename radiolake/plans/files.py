"""Queries that write files into the shared folder and read them back: documents, logs,
reports, labels, images, streams, settings, tools. Each SQL tells from the tables what
the files must give."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import geometry, images as pixels
from ..operators import registry, reports, scoring, splits
from ..operators.traces import normal_status
from ..runtime import cut_lineage, fetch, read_table, scratch, store, store_files
from ..sources import coco, logs
from ..streaming import limiter, promotion
from .base import ANNOTS, BOXED, FIRST, IMAGES, NAMED, SCORED, SEED, annots, boxed, first_pairs, images, scored
from .evaluation import _FAIL

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- annotation documents


def _documents(spark: SparkSession, sf: str, damaged: bool = True) -> tuple[str, DataFrame]:
    """(folder, its documents): the tables as one document a source file, and a broken one."""
    folder = scratch(spark, "documents")
    i = images(spark, sf).where("source_file is not null")
    a = annots(spark, sf).withColumnsRenamed({f"c{k}": f"category_id_{k}" for k in (1, 2, 3)})
    a = a.join(i.select(F.col("id").alias("image_id"), "source_file"), "image_id")
    docs = coco.document(i, a, read_table(spark, sf, "categories"))
    kind = F.when(F.contains(F.lower("source_file"), F.lit("train")), "train").otherwise("other")
    named = docs.select(F.concat(kind, F.lit("/"), F.md5("source_file"), F.lit("-"), F.col("shard").cast("string"), F.lit(".json")).alias("n"), "json")
    store_files(named, folder, "n", "json").collect()  # a name for each document
    if damaged:
        store(f"{folder}/train/broken.json", b'{"images": [')
    return folder, coco.read_documents(spark, folder)


_FILE = "CASE WHEN contains(lower(source_file), 'train') THEN 'train' ELSE 'other' END || '/' || md5(source_file) || '-0.json'"
_IN = f"{IMAGES}, {ANNOTS}, d AS (SELECT id, file_name, width, height, {_FILE} AS file FROM i WHERE source_file IS NOT NULL), k AS (SELECT *, row_number() OVER (ORDER BY file, id) AS new_id FROM d)"


@query(f"""WITH {_IN} SELECT file, count(DISTINCT k.id) AS images, count(a.id) AS annotations, (SELECT count(*) FROM categories) AS categories, (SELECT string_agg(name, ', ' ORDER BY id, name) FROM (SELECT * FROM categories ORDER BY id, name LIMIT 8)) AS names
    FROM k LEFT JOIN a ON a.image_id = k.id GROUP BY file""")
def document_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Documents found below a folder, broken ones skipped, and what is in them."""
    folder, docs = _documents(spark, sf)
    s = coco.summary(docs, folder.removeprefix("file:").replace("///", "/"))
    return s.select("file", F.col("images").cast("bigint").alias("images"), F.col("annotations").cast("bigint").alias("annotations"), F.col("categories").cast("bigint").alias("categories"), "names")


@query(f"WITH {_IN} SELECT new_id AS id, file_name, width, height FROM k")
def document_images(spark: SparkSession, sf: str) -> DataFrame:
    """All documents' images under ids 1 .. N."""
    return coco.tables(_documents(spark, sf)[1])[0].select("id", "file_name", "width", "height")


@query(f"WITH {_IN} SELECT a.id, k.new_id AS image_id, a.c1 AS category_id_1, a.c2 AS category_id_2, a.c3 AS category_id_3 FROM a JOIN k ON k.id = a.image_id")
def document_annotations(spark: SparkSession, sf: str) -> DataFrame:
    """All documents' annotations, led to the new ids."""
    return coco.tables(_documents(spark, sf)[1])[1].select("id", "image_id", "category_id_1", "category_id_2", "category_id_3")


@query("SELECT id, name FROM categories")
def document_categories(spark: SparkSession, sf: str) -> DataFrame:
    """The categories of the first document that has any."""
    return coco.tables(_documents(spark, sf)[1])[2].select("id", "name")


@query(f"""WITH {_IN}, s AS (SELECT file, contains(file, 'train')::INT * 2 + max(coalesce(a.c1 IS NOT NULL, false)::INT) + max(coalesce(a.c2 IS NOT NULL, false)::INT) + max(coalesce(a.c3 IS NOT NULL, false)::INT) + max(coalesce(a.bbox IS NOT NULL, false)::INT) AS score FROM k LEFT JOIN a ON a.image_id = k.id GROUP BY file)
    SELECT file FROM s ORDER BY score DESC, file LIMIT 1""")
def best_document(spark: SparkSession, sf: str) -> DataFrame:
    """The document most fit for training; of equals the first path."""
    folder, docs = _documents(spark, sf)
    best = coco.best(docs, "train")
    return docs.where(F.col("path") == best).select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("file"))


@query(f"""WITH {_IN}, f AS (SELECT file, arg_min({{'a': a.c1, 'b': a.c2}}, {{'id': a.id, 'i': a.image_id, 'x': coalesce(a.c1, -1), 'y': coalesce(a.c2, -1)}}) AS s FROM k JOIN a ON a.image_id = k.id WHERE contains(file, 'train') GROUP BY file)
    SELECT file FROM f WHERE s.a IS NOT NULL AND s.b IS NOT NULL""")
def enumerated_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Training documents whose first annotation has quadrant and position."""
    return coco.enumerated(_documents(spark, sf)[1], "train").select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("file"))


@query(f"WITH {_IN} SELECT 'images' AS tab, count(*) AS n FROM k UNION ALL SELECT 'annotations', count(*) FROM a JOIN k ON k.id = a.image_id UNION ALL SELECT 'categories', count(*) FROM categories")
def cached_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The loader writes its tables once and reads them from there the next time, when the
    documents are no longer asked for."""
    folder, _ = _documents(spark, sf)
    cache = scratch(spark, "cache")
    coco.load(spark, folder, "train", combine=True, cache=cache)
    again = coco.load(spark, f"{folder}/nothing", "train", combine=True, cache=cache)
    one, *rest = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("tab"), "n") for name, t in zip(("images", "annotations", "categories"), again)]
    for r in rest:
        one = one.unionByName(r)
    return one


@query("SELECT 'b' AS found")
def dataset_root(spark: SparkSession, sf: str) -> DataFrame:
    """The first of some folders that has training data and a document of it."""
    folder = scratch(spark, "roots")
    for name in ("a/training_data/x.png", "b/training_data/x.png", "b/y/train_1.json", "c/training_data/x.png", "c/train.json"):
        store(f"{folder}/{name}", b"{}")
    found = coco.find_root(spark, [f"{folder}/{x}" for x in "0abc"], "train")
    return spark.range(1).select(F.lit((found or "").rsplit("/", 1)[-1]).alias("found"))


# ---- logs


def _trace_log(spark: SparkSession, sf: str) -> str:
    """A log of traces as lines, appended twice, with blank and damaged lines in it."""
    folder = scratch(spark, "traces")
    t = read_table(spark, sf, "train_cot_traces_unverified").select("image_id", "image_path", "status", "provider", "ground_truth", "trajectory", "failure_reason")
    logs.append_lines(t.where("image_id is not null"), f"{folder}/log.jsonl")
    logs.append_lines(t.where("image_id is null"), f"{folder}/log.jsonl")
    store(f"{folder}/log.jsonl/more.json", b'\n{"image_id": 1, "status"\n   \nnothing\n')
    return folder


@query("SELECT status, count(*) AS n, count(image_id) AS images, CAST(sum(coalesce(len(ground_truth), 0)) AS BIGINT) AS findings FROM train_cot_traces_unverified GROUP BY status")
def trace_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A log read back by the name of its missing .json twin."""
    log = logs.read_traces(spark, _trace_log(spark, sf) + "/log.json")
    return log.groupBy("status").agg(F.count("*").alias("n"), F.count("image_id").alias("images"), F.sum(F.coalesce(F.size("ground_truth"), F.lit(0))).cast("bigint").alias("findings"))


@query("SELECT DISTINCT image_id FROM train_cot_traces_unverified WHERE image_id IS NOT NULL AND status <> 'generation_failed'")
def completed_images(spark: SparkSession, sf: str) -> DataFrame:
    return logs.completed(logs.read_lines(spark, _trace_log(spark, sf) + "/log.jsonl", logs.TRACE))


@query(f"WITH {FIRST} SELECT record_id, (record_id % 2)::INT AS pass, tool_calls FROM f")
def resumed_results(spark: SparkSession, sf: str) -> DataFrame:
    """Results appended in two passes, the second on what the first left over; one that was
    written again by a task's second try counts once."""
    path = scratch(spark, "results")
    schema = "record_id long, pass int, tool_calls int, at int"
    todo = first_pairs(spark, sf).select("record_id", "tool_calls")
    first = todo.where("record_id % 2 = 0")
    logs.append_results(first.select("record_id", F.lit(0).alias("pass"), "tool_calls", F.lit(1).alias("at")), path)
    done = logs.read_results(spark, path, schema, "record_id", "at")
    left = todo.join(done, "record_id", "left_anti").select("record_id", F.lit(1).alias("pass"), "tool_calls", F.lit(2).alias("at"))
    logs.append_results(left, path)
    logs.append_results(first.select("record_id", F.lit(0).alias("pass"), "tool_calls", F.lit(1).alias("at")), path)
    return logs.read_results(spark, path, schema, "record_id", "at").select("record_id", "pass", "tool_calls")


# Published measurements of five folds (fold, mAP50, mAP50-95, precision, recall).
FOLDS = [
    (0, 0.5854, 0.3355, 0.5513, 0.8673),
    (1, 0.5901, 0.3464, 0.5457, 0.8880),
    (2, 0.5726, 0.3263, 0.5304, 0.8393),
    (3, 0.5734, 0.3408, 0.5464, 0.8485),
    (4, 0.5887, 0.3405, 0.5486, 0.8344),
]


@query("WITH f(fold, map50, map95) AS (VALUES " + ", ".join(f"({a}, {b}::DOUBLE, {c}::DOUBLE)" for a, b, c, *_ in FOLDS) + ") SELECT round(avg(map50), 6) AS mean_map50, round(stddev_pop(map50), 6) AS std_map50, round(avg(map95), 6) AS mean_map95, round(stddev_pop(map95), 6) AS std_map95, CAST(arg_max(fold, map95) AS INTEGER) AS best_fold FROM f")
def cv_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Training logs of five folds, the last epoch of each, their mean and deviation, the best fold."""
    folder = scratch(spark, "folds")
    for fold, *m in FOLDS:
        head = "epoch,  fold,   metrics/mAP50(B), metrics/mAP50-95(B), metrics/precision(B), metrics/recall(B)\n"
        store(f"{folder}/{fold}.csv", (head + "".join(f"  {e}, {fold}, " + ", ".join(f"{x - (3 - e) / 100:.4f}" for x in m) + "\n" for e in (1, 2, 3))).encode())
    last = logs.last_epoch(logs.training_log(spark, folder), by=["fold"])
    a, b = F.col("`metrics/mAP50(B)`"), F.col("`metrics/mAP50-95(B)`")
    r = lambda c: F.round(c, 6)
    return last.agg(r(F.avg(a)).alias("mean_map50"), r(F.stddev_pop(a)).alias("std_map50"), r(F.avg(b)).alias("mean_map95"), r(F.stddev_pop(b)).alias("std_map95"), F.max_by("fold", b).cast("int").alias("best_fold"))


# ---- reports


_CELL = "format('{:.3f}', {})"


@query(f"""WITH {SCORED}, m AS (SELECT record_id % 2 AS run, avg(format_ok::INT)::DOUBLE AS f, avg(tool_calls)::DOUBLE AS c FROM t GROUP BY 1)
    SELECT '| run ' || run || ' | ' || format('{{:.3f}}', f) || ' | – | – | – | – | – | ' || format('{{:.3f}}', c) || ' |' AS line FROM m""")
def report_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of a written report: two runs with what is known of them."""
    m = scored(spark, sf).groupBy((F.col("record_id") % 2).alias("run")).agg(F.avg(F.col("format_ok").cast("double")).alias("format_adherence"), F.avg("tool_calls").alias("mean_tool_calls"))
    rows = {f"run {r['run']}": {"format_adherence": r["format_adherence"], "mean_tool_calls": r["mean_tool_calls"]} for r in sorted(m.collect())}  # two rows
    folder = scratch(spark, "report")
    reports.write_report(rows, folder)
    return spark.read.text(f"{folder}/report.md").where("value like '| run%'").select(F.col("value").alias("line"))


@query(f"WITH {FIRST}, c AS (SELECT {_FAIL} AS category FROM f) SELECT category, count(*) AS n FROM c GROUP BY category")
def failure_files(spark: SparkSession, sf: str) -> DataFrame:
    """Failures written by category and counted from there."""
    path = scratch(spark, "failures")
    f = first_pairs(spark, sf).select("record_id", scoring.failure(F.col("format_ok"), F.col("pr"), F.col("tr")).alias("category"))
    reports.failure_log(f, path)
    return spark.read.schema("record_id long, category string").json(path).groupBy("category").agg(F.count("*").alias("n"))


# Rounded half up as the number is written, not as it is stored.
_SIXTH = "round(CAST(CAST({} AS VARCHAR) AS DECIMAL(38, 17)), 6)"
_CLIP = "least(greatest({}, 0.0), 1.0)"
_YOLO = [_CLIP.format(e) for e in ("(x + w / 2) / width", "(y + h / 2) / height", "w / width", "h / height")]


@query(f"""WITH {BOXED} SELECT image_id || '.txt' AS name, count(*) AS boxes, CAST(sum((q - 1) * 8 + p - 1) AS BIGINT) AS classes, round(sum({_SIXTH.format(_YOLO[0])})::DOUBLE, 6) AS cx, round(sum({_SIXTH.format(_YOLO[3])})::DOUBLE, 6) AS nh FROM b WHERE q BETWEEN 1 AND 4 AND p BETWEEN 1 AND 8 GROUP BY image_id""")
def label_files(spark: SparkSession, sf: str) -> DataFrame:
    """A label file to each image, read back and added up."""
    folder = scratch(spark, "labels")
    n = geometry.normalised_centre(geometry.Box(*[F.col(c) for c in "xywh"]), F.col("width"), F.col("height"))
    labels = boxed(spark, sf).where("q between 1 and 4 and p between 1 and 8").select("image_id", "id", ((F.col("q") - 1) * 8 + F.col("p") - 1).cast("int").alias("label_class"), *[c.alias(a) for a, c in zip(("cx", "cy", "nw", "nh"), n)])
    text = reports.label_lines(labels).select(F.concat(F.col("image_id").cast("string"), F.lit(".txt")).alias("n"), "text")
    store_files(text, folder, "n", "text").agg(F.count("*")).collect()
    lines = spark.read.text(folder).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.split("value", " ").alias("v"))
    v = lambda i, t="double": F.col("v")[i].cast(t)
    return lines.groupBy("name").agg(F.count("*").alias("boxes"), F.sum(v(0, "bigint")).alias("classes"), F.round(F.sum(v(1)), 6).alias("cx"), F.round(F.sum(v(4)), 6).alias("nh"))


@query("SELECT '  ' || i || ': ''' || (i // 8 + 1) || (i % 8 + 1) || '''' AS line FROM range(32) t(i)")
def dataset_note_names(spark: SparkSession, sf: str) -> DataFrame:
    """The names in a written dataset description."""
    path = scratch(spark, "note") + "/dataset.yaml"
    store(path, reports.dataset_note(spark, "/d").encode())
    return spark.read.text(path).where("value like '  %'").select(F.col("value").alias("line"))


@query(f"""WITH {IMAGES}, r AS ({splits.ranked_sql('i', 'id', 99)}), f AS (SELECT id, {splits.part_of_sql(5)} AS part FROM r) SELECT part AS fold, count(*) AS images FROM f GROUP BY part""")
def fold_summary_file(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of folds as written to a JSON file."""
    path = scratch(spark, "fold")
    sizes = splits.parts(images(spark, sf), "id", 5, 99).groupBy(F.col("part").alias("fold")).agg(F.count("*").alias("images"))
    sizes.write.json(path)
    return spark.read.schema("fold int, images bigint").json(path)


@query("SELECT source_file AS tag, split AS note, row_number() OVER (ORDER BY md5(source_file)) = count(*) OVER () AS latest FROM annotation_files")
def checkpoint_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Notes of checkpoints listed, and which is the latest: by its time, not its name."""
    folder = scratch(spark, "notes")
    rows = sorted((r["h"], r["source_file"], r["split"]) for r in read_table(spark, sf, "annotation_files").select(F.md5("source_file").alias("h"), "source_file", "split").collect())  # a fixed, small table
    for i, (h, tag, note) in enumerate(rows):
        reports.run_note(folder, h, tag=tag, note=note, timestamp=f"2026-01-01T00:{i:02d}:00")
    notes = reports.run_notes(spark, folder, "tag string, note string, timestamp string")
    last = reports.latest(notes, "tag", "timestamp").select("tag").scalar()
    return notes.select("tag", "note", (F.col("tag") == last).alias("latest"))


@query("SELECT '  - ' || name || ': ' || n || ' images, ' || country || ', ' || license || ', ' || CASE WHEN reg THEN 'registration required' ELSE 'no registration' END AS line FROM (VALUES " + ", ".join(f"('{a}', {b}, '{c}', '{d}', {f})" for a, b, c, d, _, f, _ in logs.CATALOG) + ") v(name, n, country, license, reg)")
def catalog_text(spark: SparkSession, sf: str) -> DataFrame:
    return logs.catalog_lines(spark)


@query("""SELECT DISTINCT '{"state_id":' || state_id || coalesce(',"tools_used":[' || array_to_string(list_transform(list_sort(tools_used), lambda x: '"' || x || '"'), ',') || ']', '') || ',"image":"<Image>"}' AS json FROM trace_gen_state WHERE state_id IS NOT NULL""")
def plain_json(spark: SparkSession, sf: str) -> DataFrame:
    """Rows as JSON in which sets are sorted and images are marks."""
    s = read_table(spark, sf, "trace_gen_state").where("state_id is not null").select("state_id", "tools_used", F.lit("x").cast("binary").alias("image"))
    return reports.jsonable(s).distinct()


# ---- images


def _bytes(hex_: str | Column) -> Column:
    return F.unhex(F.lit(hex_) if isinstance(hex_, str) else hex_)


def _big(c: Column, size: int) -> Column:
    return F.lpad(F.hex(c.cast("bigint")), 2 * size, "0")


def _little(c: Column, size: int) -> Column:
    b = _big(c, size)
    return F.concat(*[F.substring(b, 2 * (size - i) - 1, 2) for i in range(size)])


def _film(k: Column, w: Column, h: Column) -> Column:
    """The head of an image file of a kind that k tells: two PNG modes, GIF, BMP, JPEG, or no image."""
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), _big(w, 4), _big(h, 4), F.lit("08"), F.when(k == 0, "00").otherwise("02"), F.lit("000000"))
    gif = F.concat(F.lit("474946383961"), _little(w, 2), _little(h, 2), F.lit("F70000"))
    bmp = F.concat(F.lit("424D000000000000000036000000" + "28000000"), _little(w, 4), _little(h, 4), F.lit("01001800"))
    jpeg = F.concat(F.lit("FFD8FFE00004" + "4A46" + "FFC00011" + "08"), _big(h, 2), _big(w, 2), F.lit("03012200021101031101"))
    return _bytes(F.when(k <= 1, png).when(k == 2, gif).when(k == 3, bmp).when(k == 4, jpeg).otherwise(F.lit("00FFD8")))


_KINDS = "CASE k WHEN 0 THEN 'png' WHEN 1 THEN 'png' WHEN 2 THEN 'gif' WHEN 3 THEN 'bmp' WHEN 4 THEN 'jpeg' END"
_MODES = "CASE k WHEN 0 THEN 'L' WHEN 1 THEN 'RGB' WHEN 2 THEN 'P' WHEN 3 THEN 'RGB' WHEN 4 THEN 'RGB' END"


@query(f"""WITH f AS (SELECT source_file, length(source_file) AS w, length(dataset) AS h, length(source_file) % 6 AS k FROM annotation_files)
    SELECT md5(source_file) || '.png' AS name, {_KINDS} AS kind, {_MODES} AS mode, CAST(CASE WHEN k < 5 THEN w END AS INTEGER) AS width, CAST(CASE WHEN k < 5 THEN h END AS INTEGER) AS height FROM f""")
def image_files(spark: SparkSession, sf: str) -> DataFrame:
    """A folder of image files of all kinds, some damaged: what their heads tell."""
    folder = scratch(spark, "films")
    f = read_table(spark, sf, "annotation_files")
    w, h = F.length("source_file"), F.length("dataset")
    store_files(f.select(F.concat(F.md5("source_file"), F.lit(".png")).alias("n"), _film(w % 6, w, h).alias("c")), folder, "n", "c").collect()  # a fixed, small table
    return logs.image_listing(spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "kind", "mode", "width", "height")


@query(f"WITH {IMAGES}, f AS (SELECT id % 6 AS k FROM i WHERE width > 0 AND height > 0) SELECT coalesce({_MODES}, 'no image') AS mode, count(*) AS n FROM f GROUP BY 1")
def colour_modes(spark: SparkSession, sf: str) -> DataFrame:
    """Images by colour mode, and how many bytes are no image, over a file's head for every image."""
    i = images(spark, sf).where("width > 0 and height > 0")
    head = pixels.header(_film(F.col("id") % 6, F.col("width"), F.col("height")))
    return i.select(head.alias("h")).groupBy(F.coalesce("h.mode", F.lit("no image")).alias("mode")).agg(F.count("*").alias("n"))


@query(f"""WITH {IMAGES} SELECT id, to_base64(encode(id || ':' || coalesce(width, 0))) AS text FROM i""")
def base64_images(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes as text that a message can carry."""
    body = F.concat(F.col("id").cast("string"), F.lit(":"), F.coalesce("width", F.lit(0)).cast("string"))
    return images(spark, sf).select("id", F.base64(body.cast("binary")).alias("text"))


def _rasters(spark: SparkSession, sf: str) -> DataFrame:
    """A made-up film of 8 by 4 grey values to each image id."""
    grey = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: _big((F.col("id") * 31 + i * 17) % 256, 1))
    return images(spark, sf).select("id", _bytes(F.array_join(grey, "")).alias("px"))


def _sum(c: Column) -> Column:
    """The total of a binary's bytes."""
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.conv(F.hex(F.substring(c, i, F.lit(1))), 16, 10).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)


_PX = f"{IMAGES}, g AS (SELECT id, list_transform(range(0, 32), lambda i: (id * 31 + i * 17) % 256) AS g FROM i)"


@query(f"""WITH {_PX}, m AS (SELECT id, g, CAST(floor(list_avg(g) + 0.5) AS FLOAT) AS mean FROM g)
    SELECT id, CAST(list_sum(list_transform(g, lambda x: CAST(trunc(((least(greatest(x, 78), 178) - 78)::FLOAT / 100::FLOAT) * 255::FLOAT) AS BIGINT))) AS BIGINT) AS bone,
        CAST(list_sum(list_transform(g, lambda x: CAST(trunc(((least(greatest(x, 50), 250) - 50)::FLOAT / 200::FLOAT) * 255::FLOAT) AS BIGINT))) AS BIGINT) AS own,
        CAST(list_sum(list_transform(g, lambda x: CAST(trunc(least(greatest(mean + 1.5::FLOAT * (x::FLOAT - mean), 0), 255)) AS BIGINT))) AS BIGINT) AS contrast,
        CAST(list_sum(list_filter(g, lambda x, i: (i - 1) % 8 BETWEEN 2 AND 5 AND (i - 1) // 8 BETWEEN 1 AND 2)) AS BIGINT) AS crop,
        CAST(list_sum(list_filter(g, lambda x, i: (i - 1) % 8 IN (1, 2, 5, 6) AND (i - 1) // 8 BETWEEN 1 AND 2)) AS BIGINT) AS pair FROM m""")
def pixel_tools(spark: SparkSession, sf: str) -> DataFrame:
    """Display window, contrast, crop and comparison over a film of each image, by their totals."""
    at = lambda *n: [F.lit(x) for x in n]
    w, p = F.lit(8), F.col("px")
    done = _rasters(spark, sf).select(
        "id", pixels.windowed("bone")(p).alias("bone"), pixels.windowed("bone", 150.0, 200.0)(p).alias("own"), pixels.contrasted(1.5)(p, w).alias("contrast"),
        pixels.crops()(p, w, *at(2, 1, 6, 3)).alias("crop"), pixels.comparisons()(p, w, *at(1, 1, 3, 3), *at(5, 1, 7, 3)).alias("pair"),
    )
    return done.select("id", *[_sum(F.col(c)).alias(c) for c in ("bone", "own", "contrast", "crop", "pair")])


@query("SELECT source_file, CAST(200 + length(dataset) AS INTEGER) AS width, 'png' AS kind, 'L' AS mode, true AS ok FROM annotation_files")
def synthetic_films(spark: SparkSession, sf: str) -> DataFrame:
    """A made-up film for every annotation file: written as PNG, listed and passed by the gate."""
    folder = scratch(spark, "synthetic")

    def draw(batches):
        for b in batches:
            yield pd.DataFrame({"n": b["n"], "c": [pixels.png(pixels.synthetic(w, 128, i, [(1, 3)])) for i, w in enumerate(b["w"])], "px": [pixels.synthetic(w, 128, i, [(1, 3)]).tobytes() for i, w in enumerate(b["w"])], "w": b["w"]})

    f = read_table(spark, sf, "annotation_files").select("source_file", F.concat(F.md5("source_file"), F.lit(".png")).alias("n"), (F.length("dataset") + 200).alias("w"))
    films = cut_lineage(f.select("n", "w").mapInPandas(draw, "n string, c binary, px binary, w int"))
    store_files(films, folder, "n", "c").collect()
    listed = logs.image_listing(spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("n"), "kind", "mode", "width")
    good = films.select("n", pixels.quality_gate("px", "w")["ok"].alias("ok"))
    return f.join(listed, "n").join(good, "n").select("source_file", "width", "kind", "mode", "ok")


@query(f"WITH {IMAGES} SELECT id, CAST(round(5 + s * 20) AS INTEGER) AS diameter, CAST(round(20 + s * 180) AS INTEGER) AS sigma, CAST(round(3 + s * 10) + (round(3 + s * 10) % 2 = 0)::INT AS INTEGER) AS kernel FROM (SELECT id, (id % 101) / 100.0 AS s FROM i)")
def denoise_settings(spark: SparkSession, sf: str) -> DataFrame:
    """Filter parameters of a strength that the id tells."""
    names = ("diameter", "sigma", "kernel")
    return images(spark, sf).select("id", *[c.alias(n) for n, c in zip(names, pixels.denoise_parameters((F.col("id") % 101) / 100.0))])


# ---- tools


@query(f"""WITH {BOXED}, s AS (SELECT *, id % 3 AS k, least(w * 1.5, width) AS nw, least(h * 1.5, height) AS nh FROM b)
    SELECT id, CASE k WHEN 0 THEN 'zoom_crop' WHEN 1 THEN 'nudge_crop' ELSE 'no_such_tool' END AS tool, round(CASE k WHEN 0 THEN greatest(x - greatest(w * 0.2, 50.0), 0.0) WHEN 1 THEN round(greatest(0.0, least(x + w / 2 + 0.25 * w - nw / 2, width - nw)), 1) END, 6) AS x FROM s""")
def dispatched_tools(spark: SparkSession, sf: str) -> DataFrame:
    """Tools called by the names that rows give, on the original image's size; unknown ones give null."""
    k = F.col("id") % 3
    b = boxed(spark, sf).withColumn("tool", F.when(k == 0, "zoom_crop").when(k == 1, "nudge_crop").otherwise("no_such_tool"))
    box, size = geometry.Box(*[F.col(c) for c in "xywh"]), (F.col("width"), F.col("height"))
    got = registry.default_registry().dispatch(F.col("tool"), {"zoom_crop": (box, *size), "nudge_crop": (box, *size, F.lit(0.25), F.lit(-0.5), F.lit(1.5))})
    return b.select("id", "tool", F.round(got["x"], 6).alias("x"))


@query("SELECT unnest(['contralateral_compare', 'denoise', 'enhance_contrast', 'fdi_label', 'locate_tooth', 'nudge_crop', 'window_level', 'zoom_crop']) AS tool, true AS told")
def tool_prompt(spark: SparkSession, sf: str) -> DataFrame:
    """The registered tools, and whether a prompt made from them tells of each."""
    r = registry.default_registry()
    prompt = r.prompt("Tools:\n{tools}\nOne JSON object a turn.")
    return spark.createDataFrame([(n, f"- {n}(" in prompt) for n in r.names()], "tool string, told boolean")


@query("SELECT * FROM (VALUES ('seed', '7'), ('data.holdout_fraction', '0.2'), ('training.reward_weights.accuracy', '1.0'), ('training.reward_weights.format', '0.4'), ('training.lora.r', '8'), ('evaluation.bootstrap_n', '2000')) v(name, value)")
def settings(spark: SparkSession, sf: str) -> DataFrame:
    """Settings from a file with another laid over it, key by key."""
    folder = scratch(spark, "settings")
    store(f"{folder}/a.json", b'{"seed": 7, "training": {"lora": {"r": 8}, "reward_weights": {"format": 0.4}}}')
    store(f"{folder}/b.json", b'{"data": {"split": "val"}}')
    c = config.load(f"{folder}/a.json", f"{folder}/b.json")
    rows = [("seed", c.seed), ("data.holdout_fraction", c.data.holdout_fraction), ("training.reward_weights.accuracy", c.training.reward_weights.accuracy), ("training.reward_weights.format", c.training.reward_weights.format), ("training.lora.r", c.training.lora.r), ("evaluation.bootstrap_n", c.evaluation.bootstrap_n)]
    return spark.createDataFrame([(n, str(v)) for n, v in rows], "name string, value string")


# ---- streams


def _rocks(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@query("SELECT DISTINCT image_id FROM train_cot_traces_unverified WHERE image_id % 3 <> 0 AND regexp_replace(lower(status), '[^a-z]', '', 'g') = 'unverified'")
def stream_promotion(spark: SparkSession, sf: str) -> DataFrame:
    """A log taken up as a stream in two runs; what a verdict passes is in the verified log once."""
    log, verified, marks = (scratch(spark, n) for n in ("log", "verified", "marks"))
    t = read_table(spark, sf, "train_cot_traces_unverified").select("image_id", "image_path", "status", "provider", "ground_truth", "trajectory", "failure_reason")
    for part in (0, 1):
        t.where(F.coalesce(F.col("image_id"), F.lit(0)) % 2 == part).write.mode("append").json(log)
        promotion.promote(spark, log, verified, marks, F.col("image_id") % 3 != 0).awaitTermination()
    return spark.read.schema("image_id long").json(verified).select("image_id")


@query("SELECT DISTINCT image_id FROM train_cot_traces_unverified WHERE image_id IS NOT NULL AND regexp_replace(lower(status), '[^a-z]', '', 'g') = 'unverified'")
def stream_successes(spark: SparkSession, sf: str) -> DataFrame:
    """The first success of every image in a stream."""
    _rocks(spark)
    source, out, marks = (scratch(spark, n) for n in ("source", "out", "marks"))
    t = read_table(spark, sf, "train_cot_traces_unverified").select("image_id", "status", "written_at")
    t.write.parquet(source)
    s = promotion.successes(spark.readStream.schema(t.schema).parquet(source)).select("image_id")
    s.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("image_id long").parquet(out)


@query()
def stream_limiter(spark: SparkSession, sf: str) -> DataFrame:
    """Calls held back by the stateful limiter, by provider and reason, in two batches (no SQL
    twin: every verdict depends on the ones before; held against a plain loop in the tests)."""
    _rocks(spark)
    source, out, marks = (scratch(spark, n) for n in ("calls", "out", "marks"))
    e = read_table(spark, sf, "events").where("ts is not null")
    e.select(F.col("event_type").alias("provider"), F.when(F.col("user_id") % 2 == 0, "gen").otherwise("ver").alias("role"), F.col("ts").cast("timestamp").alias("ts")).write.parquet(source)
    stream = spark.readStream.schema("provider string, role string, ts timestamp").parquet(source)
    limiter.limited(stream, 30, 3, 600, 60, 50).writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(limiter.OUT).parquet(out).groupBy("provider", F.col("reason")).agg(F.count("*").alias("n"))
