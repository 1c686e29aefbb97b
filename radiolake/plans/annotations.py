"""Queries over annotations and images: loading, checking, counting, geometry, partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fdi, geometry
from ..functions.paths import basename, clean_text, dirname, place
from ..operators import splits, stats
from ..operators.ranking import id_ranges, mixed, mixed_sql, running_total
from ..runtime import read_table
from ..sources.coco import resolved, usable_path
from .base import ANNOTS, BOXED, DIAGNOSES, IMAGES, NAMED, SEED, annots, boxed, images, named_annots

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_CELLS = ", ".join(f"count(*) FILTER (WHERE diagnosis = '{d}') AS {d.lower().replace(' ', '_')}" for d in DIAGNOSES)


@query(f"WITH {NAMED} SELECT q AS quadrant, {_CELLS} FROM n WHERE diagnosis IS NOT NULL AND q IS NOT NULL GROUP BY q")
def quadrant_diagnosis_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return stats.crosstab(named_annots(spark, sf).withColumnRenamed("q", "quadrant"), "quadrant", "diagnosis", DIAGNOSES)


@query(f"WITH {NAMED} SELECT diagnosis, count(*) AS n FROM n WHERE diagnosis IS NOT NULL GROUP BY diagnosis")
def diagnosis_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return stats.value_counts(named_annots(spark, sf), F.col("diagnosis"), "diagnosis")


@query(f"""WITH {BOXED} SELECT id, image_id, x + w - width AS over_right, y + h - height AS over_bottom FROM b
    WHERE x < 0 OR y < 0 OR x + w > width OR y + h > height""")
def annots_out_of_bounds(spark: SparkSession, sf: str) -> DataFrame:
    b = boxed(spark, sf)
    box = geometry.Box(*[F.col(c) for c in "xywh"])
    return b.where(geometry.out_of_bounds(box, F.col("width"), F.col("height"))).select("id", "image_id", (F.col("x") + F.col("w") - F.col("width")).alias("over_right"), (F.col("y") + F.col("h") - F.col("height")).alias("over_bottom"))


@query(f"""WITH {ANNOTS}, g AS (SELECT image_id, count(*) AS k FROM a WHERE image_id IS NOT NULL GROUP BY image_id)
    SELECT count(k) AS n, round(avg(k), 6) AS mean, round(stddev_samp(k), 6) AS std, CAST(min(k) AS DOUBLE) AS least, round(quantile_cont(k, 0.25), 6) AS q25,
           round(quantile_cont(k, 0.5), 6) AS q50, round(quantile_cont(k, 0.75), 6) AS q75, CAST(max(k) AS DOUBLE) AS greatest FROM g""")
def annotations_per_image_describe(spark: SparkSession, sf: str) -> DataFrame:
    per = annots(spark, sf).where("image_id is not null").groupBy("image_id").agg(F.count("*").alias("k"))
    return stats.describe(per, F.col("k"))


@query(f"""WITH {BOXED} SELECT count(*) AS n, round(avg(w * h), 4) AS mean_area, round(median(w * h), 4) AS median_area,
    round(avg(w * h / (CAST(width AS DOUBLE) * height)), 6) AS mean_share, round(median(w * h / (CAST(width AS DOUBLE) * height)), 6) AS median_share FROM b""")
def bbox_area_stats(spark: SparkSession, sf: str) -> DataFrame:
    area = F.col("w") * F.col("h")
    part = area / (F.col("width").cast("double") * F.col("height"))
    b = boxed(spark, sf)
    medians = stats.quantiles(b, {"area": area, "share": part}, [0.5]).agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in ("area", "share")]).select(F.struct("*").alias("m")).scalar()
    whole = b.agg(F.count("*").alias("n"), F.round(F.avg(area), 4).alias("mean_area"), F.round(F.avg(part), 6).alias("mean_share")).withColumn("m", medians)
    return whole.select("n", "mean_area", F.round("m.area", 4).alias("median_area"), "mean_share", F.round("m.share", 6).alias("median_share"))


@query(f"""WITH {BOXED}, v AS (SELECT w * h AS v FROM b), e AS (SELECT min(v) AS lo, max(v) AS hi FROM v)
    SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((v - lo) / ((hi - lo) / 30)), 29) END AS INTEGER) AS bin, count(*) AS n FROM v, e GROUP BY 1""")
def bbox_area_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return stats.histogram(boxed(spark, sf), F.col("w") * F.col("h"), 30)


@query(f"""WITH {BOXED}, v AS (SELECT w * h / (CAST(width AS DOUBLE) * height) AS v FROM b), e AS (SELECT min(v) AS lo, max(v) AS hi FROM v)
    SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((v - lo) / ((hi - lo) / 40)), 39) END AS INTEGER) AS bin, count(*) AS n FROM v, e GROUP BY 1""")
def bbox_share_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """The boxes' shares of their images in forty bins."""
    return stats.histogram(boxed(spark, sf), F.col("w") * F.col("h") / (F.col("width").cast("double") * F.col("height")), 40)


@query(f"""WITH {IMAGES} SELECT count(*) AS n, min(width) AS min_width, max(width) AS max_width, round(avg(width), 6) AS mean_width,
    min(height) AS min_height, max(height) AS max_height, round(avg(height), 6) AS mean_height FROM i""")
def image_dims(spark: SparkSession, sf: str) -> DataFrame:
    each = [f(c).alias(f"{n}_{c}") for c in ("width", "height") for n, f in (("min", F.min), ("max", F.max), ("mean", lambda c: F.round(F.avg(c), 6)))]
    return images(spark, sf).agg(F.count("*").alias("n"), *each)


@query(f"WITH {ANNOTS}, {IMAGES} SELECT id FROM i WHERE id IN (SELECT image_id FROM a WHERE image_id IS NOT NULL)")
def annotated_images(spark: SparkSession, sf: str) -> DataFrame:
    return images(spark, sf).select("id").join(annots(spark, sf).select(F.col("image_id").alias("id")), "id", "left_semi")


@query(f"WITH {IMAGES}, r AS ({splits.ranked_sql('i', 'id', SEED)}) SELECT i.id FROM i JOIN r USING (id) WHERE rank >= floor(n * 0.1) AND trim(local_path) <> ''")
def training_pool(spark: SparkSession, sf: str) -> DataFrame:
    i = images(spark, sf)
    pool = i.where("trim(local_path) <> ''").select("id")
    return pool.join(splits.held_out(i, "id", 0.1, SEED), "id", "left_anti")


@query(f"""WITH {NAMED} SELECT image_id, id, q AS quadrant, p AS tooth_position, coalesce(diagnosis, 'Caries') AS diagnosis FROM (
    SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY id, c1 NULLS FIRST, c2 NULLS FIRST, c3 NULLS FIRST) AS rn FROM n WHERE image_id IS NOT NULL) WHERE rn = 1""")
def first_finding(spark: SparkSession, sf: str) -> DataFrame:
    w = W.partitionBy("image_id").orderBy("id", "c1", "c2", "c3")
    first = named_annots(spark, sf).where("image_id is not null").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return first.select("image_id", "id", F.col("q").alias("quadrant"), F.col("p").alias("tooth_position"), F.coalesce("diagnosis", F.lit("Caries")).alias("diagnosis"))


@query(f"""WITH {IMAGES}, {ANNOTS}, k AS (SELECT id, row_number() OVER (ORDER BY coalesce(source_file, ''), id) AS new_id FROM i)
    SELECT a.id, k.new_id AS image_id FROM a JOIN k ON k.id = a.image_id""")
def combined_union_rekey(spark: SparkSession, sf: str) -> DataFrame:
    """All files' images under ids 1 .. N by file and old id; annotations of unknown
    images fall away. Ranges of ids, whose width follows the greatest id, are counted
    first, so no task holds a whole file."""
    i = images(spark, sf).select("id", F.coalesce("source_file", F.lit("")).alias("file"))
    keyed = running_total(i, [], ["file", "id"], F.lit(1), "before", bucket=F.struct("file", id_ranges(i, "id").alias("r"))).select(F.col("id").alias("image_id"), (F.col("before") + 1).alias("new_id"))
    return annots(spark, sf).join(keyed, "image_id").select("id", F.col("new_id").alias("image_id"))


@query(f"""WITH {IMAGES}, {ANNOTS}, s AS (
    SELECT f.source_file, f.split, max(a.c1 IS NOT NULL)::INT + max(a.c2 IS NOT NULL)::INT + max(a.c3 IS NOT NULL)::INT + max(a.bbox IS NOT NULL)::INT AS present
    FROM annotation_files f LEFT JOIN i ON i.source_file = f.source_file LEFT JOIN a ON a.image_id = i.id GROUP BY f.source_file, f.split)
    SELECT source_file, CAST(2 * (source_file LIKE '%train%')::INT + coalesce(present, 0) + 2 * regexp_matches(source_file, 'diagnosis|disease|triple')::INT AS INTEGER) AS score FROM s""")
def candidate_file_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Annotation files scored as sources of the train split: split and wording of the
    path, and which keys their annotations have. The best is the highest score, then
    the first path."""
    keys = [F.max(F.col(c).isNotNull().cast("int")).alias(f"has_{c}") for c in ("c1", "c2", "c3", "bbox")]
    per_image = annots(spark, sf).groupBy(F.col("image_id").alias("id")).agg(*keys)
    per_file = images(spark, sf).join(per_image, "id").groupBy("source_file").agg(*[F.max(f"has_{c}").alias(f"has_{c}") for c in ("c1", "c2", "c3", "bbox")])
    present = sum((F.coalesce(f"has_{c}", F.lit(0)) for c in ("c1", "c2", "c3", "bbox")), F.lit(0))
    path = F.col("source_file")
    score = F.when(path.contains("train"), 2).otherwise(0) + present + F.when(path.rlike("diagnosis|disease|triple"), 2).otherwise(0)
    return read_table(spark, sf, "annotation_files").join(per_file, "source_file", "left").select("source_file", score.cast("int").alias("score"))


@query(f"""WITH {IMAGES}, {ANNOTS}, s AS (
    SELECT f.source_file, max(a.c1 IS NOT NULL)::INT + max(a.c2 IS NOT NULL)::INT + max(a.c3 IS NOT NULL)::INT AS present
    FROM annotation_files f LEFT JOIN i ON i.source_file = f.source_file LEFT JOIN a ON a.image_id = i.id GROUP BY f.source_file)
    SELECT source_file, CAST(contains(lower(source_file), 'test')::INT + coalesce(present, 0) + 2 * regexp_matches(lower(source_file), 'diagnosis|disease')::INT AS INTEGER) AS score FROM s""")
def named_split_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Annotation files scored as the test split, by the milder rule: one for the name."""
    keys = [F.max(F.col(c).isNotNull().cast("int")).alias(f"has_{c}") for c in ("c1", "c2", "c3")]
    per_image = annots(spark, sf).groupBy(F.col("image_id").alias("id")).agg(*keys)
    per_file = images(spark, sf).join(per_image, "id").groupBy("source_file").agg(*[F.max(f"has_{c}").alias(f"has_{c}") for c in ("c1", "c2", "c3")])
    present = sum((F.coalesce(f"has_{c}", F.lit(0)) for c in ("c1", "c2", "c3")), F.lit(0))
    low = F.lower("source_file")
    score = low.contains("test").cast("int") + present + F.when(low.rlike("diagnosis|disease"), 2).otherwise(0)
    return read_table(spark, sf, "annotation_files").join(per_file, "source_file", "left").select("source_file", score.cast("int").alias("score"))


@query("SELECT source_file, contains(lower(source_file), 'val') AS val, contains(lower(source_file), 'train') AS train FROM annotation_files")
def split_of_name(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a file's name tells of a split."""
    low = F.lower("source_file")
    return read_table(spark, sf, "annotation_files").select("source_file", low.contains("val").alias("val"), low.contains("train").alias("train"))


_DIR = "regexp_extract(replace({}, chr(92), '/'), '^(.*?)/*[^/]*/*$', 1, 's')"
_BASE = "regexp_extract(replace({}, chr(92), '/'), '([^/]*)/*$', 1, 's')"


@query(f"""WITH {IMAGES}, d AS (SELECT DISTINCT CASE WHEN size_bytes % 3 = 1 THEN {_DIR.format('path')} || '/xrays/' || {_BASE.format('path')} ELSE path END AS path FROM local_files WHERE path IS NOT NULL),
    m AS (SELECT {_BASE.format('path')} AS base, max(path) AS path FROM d GROUP BY base),
    w AS (SELECT id, {_BASE.format('local_path')} AS base, CASE WHEN id % 4 = 0 THEN 'elsewhere' ELSE {_DIR.format('local_path')} END AS dir FROM i WHERE local_path IS NOT NULL)
    SELECT w.id, coalesce(d.path, x.path, m.path) AS resolved FROM w LEFT JOIN d ON d.path = w.dir || '/' || w.base LEFT JOIN d x ON x.path = w.dir || '/xrays/' || w.base LEFT JOIN m ON m.base = w.base WHERE coalesce(d.path, x.path, m.path) IS NOT NULL""")
def path_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """The file of each image: beside its source file, in the folder for films there, else
    the last file of its name. A third of the files are moved to such a folder, and a
    quarter of the images looked for in the wrong one."""
    path, old = F.col("path"), F.col("local_path")
    moved = F.when(F.col("size_bytes") % 3 == 1, F.concat(dirname(path), F.lit("/xrays/"), basename(path))).otherwise(path)
    files = read_table(spark, sf, "local_files").where("path is not null").select(moved.alias("path"))
    i = images(spark, sf).where("local_path is not null").select("id", basename(old).alias("file_name"), F.concat(F.when(F.col("id") % 4 == 0, "elsewhere").otherwise(dirname(old)), F.lit("/x.json")).alias("source_file"))
    return resolved(i, files).select("id", F.col("local_path").alias("resolved")).where("resolved is not null")


@query(f"""WITH {IMAGES}, s AS (SELECT path, min(size_bytes) AS size FROM local_files WHERE deleted_at IS NULL AND path IS NOT NULL GROUP BY path)
    SELECT id, coalesce('slices/' || lpad(CAST(id % 12 AS VARCHAR), 2, '0') || '/' || regexp_extract(replace(s.path, chr(92), '/'), '([^/]*)/*$', 1, 's'), i.local_path) AS local_path FROM i LEFT JOIN s ON s.path = i.local_path""")
def path_override(spark: SparkSession, sf: str) -> DataFrame:
    """Paths replaced by those of a fetched slice where it has the file, else kept."""
    there = read_table(spark, sf, "local_files").where("deleted_at is null and path is not null").select(F.col("path").alias("local_path"), F.lit(True).alias("hit")).distinct()
    fetched = F.concat(F.lit("slices/"), F.lpad((F.col("id") % 12).cast("string"), 2, "0"), F.lit("/"), basename(F.col("local_path")))
    return images(spark, sf).join(there, "local_path", "left").select("id", F.when(F.col("hit"), fetched).otherwise(F.col("local_path")).alias("local_path"))


@query(f"""WITH {IMAGES} SELECT id, regexp_extract(replace(file_name, chr(92), '/'), '([^/]*)/*$', 1, 's') AS base FROM i WHERE file_name IS NOT NULL""")
def image_basenames(spark: SparkSession, sf: str) -> DataFrame:
    """The last segment of each image's file name, back slashes turned."""
    return images(spark, sf).where("file_name is not null").select("id", basename(F.col("file_name")).alias("base"))


# The names as published; the SQL doesn't take them from the code under test.
_NAMES_Q = "WHEN 1 THEN 'Maxillary Right (Upper Right)' WHEN 2 THEN 'Maxillary Left (Upper Left)' WHEN 3 THEN 'Mandibular Left (Lower Left)' WHEN 4 THEN 'Mandibular Right (Lower Right)' ELSE 'Quadrant ' || q"
_NAMES_P = "WHEN 1 THEN 'Central Incisor' WHEN 2 THEN 'Lateral Incisor' WHEN 3 THEN 'Canine' WHEN 4 THEN 'First Premolar' WHEN 5 THEN 'Second Premolar' WHEN 6 THEN 'First Molar' WHEN 7 THEN 'Second Molar' WHEN 8 THEN 'Third Molar (Wisdom Tooth)' ELSE 'Tooth ' || p"
_NAME = f"(CASE q {_NAMES_Q} END) || ' ' || (CASE p {_NAMES_P} END) || ' (FDI #' || CASE WHEN q BETWEEN 1 AND 4 AND p BETWEEN 1 AND 8 THEN q || '' || p ELSE '??' END || ')'"


@query(f"""WITH {ANNOTS} SELECT id, q, p, CAST(q * 10 + p AS INTEGER) AS code, q || '' || p AS label, {_NAME} AS name,
    CAST((q - 1) * 8 + p AS INTEGER) AS detector_class, CAST((q - 1) * 8 + p - 1 AS INTEGER) AS label_class, CASE q WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 4 ELSE 3 END AS flipped, (q * 10 + p) // 10 AS back_q, (q * 10 + p) % 10 AS back_p
    FROM a WHERE q BETWEEN 1 AND 4 AND p BETWEEN 1 AND 8""")
def fdi_codes(spark: SparkSession, sf: str) -> DataFrame:
    q, p = F.col("q"), F.col("p")
    back_q, back_p = fdi.decode(fdi.code(q, p))
    return annots(spark, sf).where(fdi.valid(q, p)).select("id", "q", "p", fdi.code(q, p).alias("code"), fdi.label(q, p).alias("label"), fdi.name(q, p).alias("name"), fdi.detector_class(q, p).alias("detector_class"), fdi.label_class(q, p).alias("label_class"), fdi.flipped(q).alias("flipped"), back_q.alias("back_q"), back_p.alias("back_p"))


@query(f"WITH {ANNOTS} SELECT DISTINCT q, p, {_NAME} AS name FROM a")
def tooth_names(spark: SparkSession, sf: str) -> DataFrame:
    """The name of every tooth told, of places that there aren't too."""
    return annots(spark, sf).select("q", "p").distinct().select("q", "p", fdi.name(F.col("q"), F.col("p")).alias("name"))


@query(f"""WITH {ANNOTS}, t AS (SELECT id, CASE id % 4 WHEN 0 THEN q || '' || p WHEN 1 THEN CAST(q * 10 + p AS VARCHAR) || '0' WHEN 2 THEN q || 'x' ELSE '' END AS told FROM a),
    n AS (SELECT id, told, TRY_CAST(told[1] AS INTEGER) AS q, TRY_CAST(told[2] AS INTEGER) AS p FROM t),
    w AS (SELECT *, CASE WHEN length(told) <> 2 THEN 'not two digits: ' || told WHEN q IS NULL OR p IS NULL THEN 'not a number: ' || told WHEN NOT (q BETWEEN 1 AND 4 AND p BETWEEN 1 AND 8) THEN 'no such tooth: ' || told END AS why FROM n)
    SELECT id, CASE WHEN why IS NULL THEN q END AS quadrant, CASE WHEN why IS NULL THEN p END AS position, why FROM w""")
def tooth_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Tooth numbers written as text, in good and bad ways by id, read back or refused with the reason."""
    code = F.concat(F.col("q").cast("string"), F.col("p").cast("string"))
    k = F.col("id") % 4
    told = F.when(k == 0, code).when(k == 1, F.concat((F.col("q") * 10 + F.col("p")).cast("string"), F.lit("0"))).when(k == 2, F.concat(F.col("q").cast("string"), F.lit("x"))).otherwise("")
    q, p, why = fdi.read_number(F.col("told"))
    return annots(spark, sf).select("id", told.alias("told")).select("id", q.alias("quadrant"), p.alias("position"), why.alias("why"))


# Rounded half up as the number is written, not as it is stored.
_TENTH = "round(CAST(CAST({} AS VARCHAR) AS DECIMAL(38, 17)), 1)::DOUBLE"


def _box() -> geometry.Box:
    return geometry.Box(*[F.col(c) for c in "xywh"])


_CLIP = "least(greatest({}, 0.0), 1.0)"
_YOLO = [_CLIP.format(e) for e in ("(x + w / 2) / width", "(y + h / 2) / height", "w / width", "h / height")]


@query(f"""WITH {BOXED} SELECT image_id, id, CAST((q - 1) * 8 + p - 1 AS INTEGER) AS label_class, round({_YOLO[0]}, 6) AS cx, round({_YOLO[1]}, 6) AS cy, round({_YOLO[2]}, 6) AS nw, round({_YOLO[3]}, 6) AS nh
    FROM b WHERE q BETWEEN 1 AND 4 AND p BETWEEN 1 AND 8""")
def yolo_labels(spark: SparkSession, sf: str) -> DataFrame:
    n = geometry.normalised_centre(_box(), F.col("width"), F.col("height"))
    return boxed(spark, sf).where(fdi.valid(F.col("q"), F.col("p"))).select("image_id", "id", fdi.label_class(F.col("q"), F.col("p")).cast("int").alias("label_class"), *[F.round(c, 6).alias(a) for a, c in zip(("cx", "cy", "nw", "nh"), n)])


@query(f"""WITH {BOXED}, l AS (SELECT image_id, min(struct_pack(id := id, x := x, y := y, w := w, h := h)) AS l FROM b GROUP BY image_id),
    k AS (SELECT b.*, l.l, greatest(least(x + w, l.l.x + l.l.w) - greatest(x, l.l.x), 0) * greatest(least(y + h, l.l.y + l.l.h) - greatest(y, l.l.y), 0) AS s FROM b JOIN l USING (image_id))
    SELECT image_id, id, round(s / (w * h + l.w * l.h - s), 6) AS iou FROM k""")
def iou_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Overlap of each box with the first box of its image."""
    b = boxed(spark, sf)
    first = b.groupBy("image_id").agg(F.min(F.struct("id", *"xywh")).alias("l"))
    before = geometry.Box(*[F.col(f"l.{c}") for c in "xywh"])
    return b.join(first, "image_id").select("image_id", "id", F.round(geometry.iou(_box(), before), 6).alias("iou"))


@query(f"""WITH {BOXED}, s AS (SELECT *, least(1024.0 / width, 512.0 / height) AS s FROM b),
    o AS (SELECT *, floor((1024 - CAST(trunc(width * s) AS INTEGER)) / 2) AS l, floor((512 - CAST(trunc(height * s) AS INTEGER)) / 2) AS t FROM s)
    SELECT id, image_id, round(x * s + l, 6) AS x, round(y * s + t, 6) AS y, round(w * s, 6) AS w, round(h * s, 6) AS h FROM o""")
def letterbox_remap(spark: SparkSession, sf: str) -> DataFrame:
    s, left, top = geometry.letterbox(F.col("width"), F.col("height"), 1024, 512)
    b = geometry.remapped(_box(), s, left, top)
    return boxed(spark, sf).select("id", "image_id", *[F.round(c, 6).alias(n) for n, c in zip("xywh", b)])


@query(f"""WITH {BOXED} SELECT id, image_id, round(greatest(x - greatest(w * 0.2, 50.0), 0.0), 6) AS x1, round(greatest(y - greatest(h * 0.2, 50.0), 0.0), 6) AS y1,
    round(least(x + w + greatest(w * 0.2, 50.0), width), 6) AS x2, round(least(y + h + greatest(h * 0.2, 50.0), height), 6) AS y2 FROM b""")
def zoom_window(spark: SparkSession, sf: str) -> DataFrame:
    z = geometry.zoomed(_box(), F.col("width"), F.col("height"))
    return boxed(spark, sf).select("id", "image_id", *[F.round(c, 6).alias(n) for n, c in zip(("x1", "y1", "x2", "y2"), z)])


@query(f"""WITH {ANNOTS}, {IMAGES}, b AS (SELECT a.id, a.image_id, a.bbox, i.width, i.height, a.bbox[1] AS x, a.bbox[2] AS y, a.bbox[3] AS w, a.bbox[4] AS h, ((a.id % 7) - 3) * 0.25::DOUBLE AS dx, ((a.id % 5) - 2) * 0.5::DOUBLE AS dy, greatest(0.1::DOUBLE, (a.id % 4) * 0.75::DOUBLE) AS s
        FROM a JOIN i ON i.id = a.image_id WHERE i.width IS NOT NULL AND i.height IS NOT NULL),
    e AS (SELECT *, CASE WHEN bbox IS NULL OR len(bbox) <> 4 OR x IS NULL OR y IS NULL OR w IS NULL OR h IS NULL THEN 'the box must be x, y, w, h' WHEN w <= 0 OR h <= 0 THEN 'width and height must be positive' END AS error, least(w * s, width) AS nw, least(h * s, height) AS nh FROM b)
    SELECT id, image_id, error, CASE WHEN error IS NULL THEN {_TENTH.format('greatest(0.0, least(x + w / 2 + dx * w - nw / 2, width - nw))')} END AS x, CASE WHEN error IS NULL THEN {_TENTH.format('greatest(0.0, least(y + h / 2 + dy * h - nh / 2, height - nh))')} END AS y,
        CASE WHEN error IS NULL THEN {_TENTH.format('nw')} END AS w, CASE WHEN error IS NULL THEN {_TENTH.format('nh')} END AS h FROM e""")
def nudge(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes shifted and rescaled by amounts that vary with the id; bad boxes give the reason."""
    i = images(spark, sf).where("width is not null and height is not null").select(F.col("id").alias("image_id"), "width", "height")
    a = annots(spark, sf).join(i, "image_id")
    n, k = F.col("id"), F.col("bbox")
    b = geometry.nudged(geometry.of_array(k), F.col("width"), F.col("height"), ((n % 7) - 3) * 0.25, ((n % 5) - 2) * 0.5, (n % 4) * 0.75)
    return a.select("id", "image_id", geometry.box_error(k).alias("error"), *[c.alias(m) for m, c in zip("xywh", b)])


@query(f"""WITH {BOXED}, s AS (SELECT *, CAST(trunc(x) AS INTEGER) AS xi, CAST(trunc(y) AS INTEGER) AS yi, CAST(trunc(w) AS INTEGER) AS wi, CAST(trunc(h) AS INTEGER) AS hi, height // 2 AS mid FROM b),
    m AS (SELECT id, image_id, greatest(width - xi - wi, 0) AS x1, least(width - xi, width) AS x2, CASE WHEN q IN (1, 2) THEN greatest(yi, 0) ELSE greatest(mid, yi) END AS y1, CASE WHEN q IN (1, 2) THEN least(mid, yi + hi) ELSE least(height, yi + hi) END AS y2 FROM s)
    SELECT * FROM m WHERE x2 > x1 AND y2 > y1""")
def mirror_window(spark: SparkSession, sf: str) -> DataFrame:
    m = geometry.mirrored(_box(), F.col("width"), F.col("height"), F.col("q"))
    return boxed(spark, sf).select("id", "image_id", *[c.alias(n) for n, c in zip(("x1", "y1", "x2", "y2"), m)]).where("x1 is not null")


@query(f"WITH {BOXED} SELECT id, image_id, width - x - w AS x, y, w, h, CASE q WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 4 WHEN 4 THEN 3 ELSE q END AS quadrant FROM b")
def hflip(spark: SparkSession, sf: str) -> DataFrame:
    b = geometry.flipped(_box(), F.col("width"))
    return boxed(spark, sf).select("id", "image_id", *[c.alias(n) for n, c in zip("xywh", b)], fdi.flipped(F.col("q")).alias("quadrant"))


_DETECTED = f"""d AS (SELECT *, ({mixed_sql('id', 7)} % 1000) / 1000.0 AS score FROM b),
    r AS (SELECT *, row_number() OVER (PARTITION BY image_id, q, p ORDER BY score DESC, id, x, y, w, h) AS rn FROM d WHERE score >= 0.25),
    c AS (SELECT *, x + w / 2 AS cx, y + h / 2 AS cy FROM r WHERE rn = 1),
    o AS (SELECT *, greatest(cx - w / 2 - w * 0.2 / 2, 0.0) AS px, greatest(cy - h / 2 - h * 0.2 / 2, 0.0) AS py FROM c)"""


@query(f"""WITH {BOXED}, {_DETECTED} SELECT image_id, q, p, round(score, 3) AS confidence, {_TENTH.format('px')} AS x, {_TENTH.format('py')} AS y, {_TENTH.format('least(w * (1 + 0.2), width - px)')} AS w, {_TENTH.format('least(h * (1 + 0.2), height - py)')} AS h FROM o""")
def best_detection(spark: SparkSession, sf: str) -> DataFrame:
    """Per image and tooth the detection of the highest score, if it reaches the
    threshold (a hash stands in for the detector), from its centre to a padded box."""
    d = boxed(spark, sf).withColumn("score", (mixed(F.col("id"), 7) % 1000) / 1000.0).where(F.col("score") >= 0.25)
    w = W.partitionBy("image_id", "q", "p").orderBy(F.col("score").desc(), "id", *"xywh")
    best = d.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    centre = geometry.Box(F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2, F.col("w"), F.col("h"))
    out = geometry.from_centre(centre, F.lit(0.0), F.lit(0.0), F.col("width"), F.col("height"))
    return best.select("image_id", "q", "p", F.round("score", 3).alias("confidence"), *[c.alias(n) for n, c in zip("xywh", out)])


@query(f"""WITH {BOXED} SELECT count(*) AS n, count(*) FILTER (WHERE s >= 0.5) AS kept FROM (SELECT ({mixed_sql('id', 7)} % 1000) / 1000.0 AS s FROM b)""")
def detections_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Detections before and after the score threshold."""
    d = boxed(spark, sf).select(((mixed(F.col("id"), 7) % 1000) / 1000.0).alias("s"))
    return d.agg(F.count("*").alias("n"), F.count_if(F.col("s") >= 0.5).alias("kept"))


@query(f"""WITH {BOXED} SELECT id, round(x + w, 6) AS x2, round(y + h, 6) AS y2, round((x + w) - x, 6) AS w, round((y + h) - y, 6) AS h FROM b""")
def corner_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes by their corners and back."""
    c = geometry.corners(_box())
    back = geometry.from_corners(c)
    return boxed(spark, sf).select("id", F.round(c.w, 6).alias("x2"), F.round(c.h, 6).alias("y2"), F.round(back.w, 6).alias("w"), F.round(back.h, 6).alias("h"))


@query(f"""WITH {BOXED}, s AS (SELECT id, image_id, greatest(x - w * 0.75, 0.0) AS x1, greatest(y - h * 0.75, 0.0) AS y1, least(x + w * 1.75, width) AS x2, least(y + h * 1.75, height) AS y2 FROM b)
    SELECT id, image_id, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM s WHERE x2 > x1 AND y2 > y1""")
def hint_window(spark: SparkSession, sf: str) -> DataFrame:
    s = geometry.search_window(_box(), F.col("width"), F.col("height"))
    return boxed(spark, sf).select("id", "image_id", *[F.round(c, 6).alias(n) for n, c in zip(("x1", "y1", "x2", "y2"), s)]).where("x1 is not null")


@query(f"""WITH {BOXED}, r AS (SELECT id, {mixed_sql('id', 3)} / 2147483647.0 AS roll, {mixed_sql('id', 4)} / 2147483647.0 AS size FROM b),
    t AS (SELECT *, CASE WHEN roll < 0.3 THEN 'big' WHEN roll < 0.55 THEN 'small' ELSE 'none' END AS tier FROM r)
    SELECT id, tier, round((CASE tier WHEN 'big' THEN 0.45 + (0.75 - 0.45) * abs(size * 2 - 1) WHEN 'small' THEN 0.12 + (0.28 - 0.12) * abs(size * 2 - 1) ELSE 0.0 END) * (CASE WHEN size < 0.5 THEN -1.0 ELSE 1.0 END), 6) + 0.0 AS shift FROM t""")
def perturb_tier(spark: SparkSession, sf: str) -> DataFrame:
    roll, size = (mixed(F.col("id"), s) / 2147483647.0 for s in (3, 4))
    tier, shift = geometry.perturbation(roll, size)
    return boxed(spark, sf).select("id", tier.alias("tier"), (F.round(shift, 6) + F.lit(0.0)).alias("shift"))


@query(f"""WITH {BOXED} SELECT image_id, q AS label, min(x) AS x, min(y) AS y, max(x + w) - min(x) + 1 AS w, max(y + h) - min(y) + 1 AS h FROM b GROUP BY image_id, q""")
def mask_bbox(spark: SparkSession, sf: str) -> DataFrame:
    """The box around everything with a label: least and greatest marks, one added."""
    b = boxed(spark, sf)
    return b.groupBy("image_id", F.col("q").alias("label")).agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x") + 1).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y") + 1).alias("h"))


@query(f"WITH {IMAGES}, r AS ({splits.ranked_sql('i', 'id', SEED)}) SELECT id, {splits.part_of_sql(12)} AS part FROM r")
def slice_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return splits.parts(images(spark, sf), "id", 12, SEED)


@query(f"WITH {IMAGES}, r AS ({splits.ranked_sql('i', 'id', 99)}) SELECT id, {splits.part_of_sql(5)} AS part FROM r")
def kfold_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return splits.parts(images(spark, sf), "id", 5, 99)


@query(f"""WITH {IMAGES}, {ANNOTS}, r AS ({splits.ranked_sql('i', 'id', 99)}), f AS (SELECT id, {splits.part_of_sql(5)} AS part FROM r), c AS (SELECT image_id, count(*) AS k FROM a GROUP BY image_id)
    SELECT part AS fold, count(*) AS val_images, CAST(coalesce(sum(k), 0) AS BIGINT) AS val_annotations, (SELECT count(*) FROM f) - count(*) AS train_images FROM f LEFT JOIN c ON c.image_id = f.id GROUP BY part""")
def fold_summary(spark: SparkSession, sf: str) -> DataFrame:
    folds = splits.parts(images(spark, sf), "id", 5, 99)
    counts = annots(spark, sf).where("image_id is not null").groupBy(F.col("image_id").alias("id")).agg(F.count("*").alias("k"))
    per = folds.join(counts, "id", "left").groupBy(F.col("part").alias("fold")).agg(F.count("*").alias("val_images"), F.coalesce(F.sum("k"), F.lit(0)).alias("val_annotations"))
    whole = F.sum("val_images").over(W.partitionBy())  # five rows
    return per.select("fold", "val_images", "val_annotations", (whole - F.col("val_images")).alias("train_images"))


@query(f"""WITH {IMAGES}, {ANNOTS} SELECT i.source_file, count(DISTINCT i.id) AS images, count(a.id) AS annotations, (SELECT string_agg(name, ', ' ORDER BY id) FROM (SELECT id, max(name) AS name FROM categories GROUP BY id ORDER BY id LIMIT 8)) AS names
    FROM i LEFT JOIN a ON a.image_id = i.id WHERE i.source_file IS NOT NULL GROUP BY i.source_file""")
def file_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Images and annotations per source file, annotations counted per image first, and
    the first eight category names."""
    per_image = annots(spark, sf).where("image_id is not null").groupBy(F.col("image_id").alias("id")).agg(F.count("*").alias("k"))
    i = images(spark, sf).where("source_file is not null").join(per_image, "id", "left")
    first = read_table(spark, sf, "categories").groupBy("id").agg(F.max("name").alias("name")).orderBy("id").limit(8)
    names = first.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "name"))), lambda x: x["name"]), ", ").alias("names")).scalar()
    return i.groupBy("source_file").agg(F.count("*").alias("images"), F.coalesce(F.sum("k"), F.lit(0)).alias("annotations")).withColumn("names", names)


@query(f"""WITH {NAMED}, o AS (SELECT image_id, id, q, p, coalesce(diagnosis, 'Caries') AS d, row_number() OVER (PARTITION BY image_id ORDER BY id, q, p, coalesce(diagnosis, 'Caries'), c3 NULLS FIRST, bbox[1] NULLS FIRST, bbox[2] NULLS FIRST) - 1 AS nr FROM n WHERE image_id IS NOT NULL)
    SELECT image_id, nr // 10000 AS part, string_agg(id || ' Q' || q || 'T' || p || ':' || d, '; ' ORDER BY nr) AS findings FROM o GROUP BY 1, 2""")
def findings_by_image(spark: SparkSession, sf: str) -> DataFrame:
    """All findings of each image as lists, in the order of their ids, written out. A list
    holds at most 10,000 findings, so an image with more has several parts."""
    n = named_annots(spark, sf).where("image_id is not null").withColumn("d", F.coalesce("diagnosis", F.lit("Caries")))
    n = n.withColumn("x", F.get("bbox", 0)).withColumn("y", F.get("bbox", 1))
    lists = stats.bounded_lists(n, ["image_id"], ["id", "q", "p", "d", "c3", "x", "y"], F.struct("id", "q", "p", "d"), "findings", 10_000)
    told = F.transform("findings", lambda f: F.concat(f["id"].cast("string"), F.lit(" Q"), f["q"].cast("string"), F.lit("T"), f["p"].cast("string"), F.lit(":"), f["d"]))
    return lists.select("image_id", "part", F.array_join(told, "; ").alias("findings"))


@query(f"""WITH {NAMED} SELECT image_id, id, CASE WHEN q BETWEEN 1 AND 4 AND p BETWEEN 1 AND 8 THEN q || '' || p END AS label, diagnosis, bbox FROM n WHERE image_id IN (SELECT image_id FROM verified_traces)""")
def annotated_teeth(spark: SparkSession, sf: str) -> DataFrame:
    """Every annotated tooth of the images that have a verified trace: the stand-in for a detector."""
    asked = read_table(spark, sf, "verified_traces").select("image_id")
    return named_annots(spark, sf).join(asked, "image_id", "left_semi").select("image_id", "id", fdi.label(F.col("q"), F.col("p")).alias("label"), "diagnosis", "bbox")


@query(f"WITH {IMAGES} SELECT id FROM i WHERE local_path IS NOT NULL AND local_path <> 'None' ORDER BY id LIMIT 100")
def first_images(spark: SparkSession, sf: str) -> DataFrame:
    """The first hundred images with a path: a top-k."""
    return images(spark, sf).where(usable_path(F.col("local_path"))).select("id").orderBy("id").limit(100)


@query(f"""WITH {IMAGES}, {ANNOTS}, m AS (SELECT DISTINCT i.* FROM i JOIN annotation_files f ON f.source_file = i.source_file WHERE f.split = 'test'), u AS (SELECT id, 'train' AS part FROM i WHERE id NOT IN (SELECT id FROM m) UNION ALL SELECT id, 'test' FROM m)
    SELECT part, count(DISTINCT u.id) AS images, count(a.id) AS annotations FROM u LEFT JOIN a ON a.image_id = u.id GROUP BY part""")
def train_with_test(spark: SparkSession, sf: str) -> DataFrame:
    """The test files' images put behind the others, and both counted with their annotations."""
    i = images(spark, sf)
    test = i.join(read_table(spark, sf, "annotation_files").where("split = 'test'").select("source_file").distinct(), "source_file", "left_semi").select("id")
    both = i.select("id").join(test, "id", "left_anti").withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    per = annots(spark, sf).where("image_id is not null").groupBy(F.col("image_id").alias("id")).agg(F.count("*").alias("k"))
    return both.join(per, "id", "left").groupBy("part").agg(F.count("*").alias("images"), F.coalesce(F.sum("k"), F.lit(0)).alias("annotations"))


@query(f"""WITH {IMAGES}, {ANNOTS} SELECT i.id, count(a.id) AS annotations, coalesce(min(a.q), 0) AS least_quadrant FROM i LEFT JOIN a ON a.image_id = i.id GROUP BY i.id""")
def images_with_annotation_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Every image with its number of annotations, none included."""
    per = annots(spark, sf).where("image_id is not null").groupBy(F.col("image_id").alias("id")).agg(F.count("*").alias("k"), F.min("q").alias("m"))
    return images(spark, sf).join(per, "id", "left").select("id", F.coalesce("k", F.lit(0)).alias("annotations"), F.coalesce("m", F.lit(0)).alias("least_quadrant"))


@query(f"""WITH {IMAGES} SELECT id, regexp_extract(replace(source_file, chr(92), '/'), '^(.*?)/*[^/]*/*$', 1, 's') AS folder FROM i WHERE source_file IS NOT NULL""")
def source_folders(spark: SparkSession, sf: str) -> DataFrame:
    """The folder of each image's source file, however it is spelled; back slashes are
    turned, doubled slashes inside stay."""
    return images(spark, sf).where("source_file is not null").select("id", dirname(F.col("source_file")).alias("folder"))


@query()
def image_places(spark: SparkSession, sf: str) -> DataFrame:
    """local_path as a place; held against a brute-force version in the tests."""
    return images(spark, sf).select("id", place(F.col("local_path")).alias("place"), clean_text(F.col("file_name")).alias("file_name"))
