"""The tables as the queries see them, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fdi import from_raw
from ..runtime import read_table

SEED = 42


def annots(spark: SparkSession, sf: str) -> DataFrame:
    """Annotations without repeated rows: id, image_id, c1, c2, c3, bbox, q, p."""
    a = read_table(spark, sf, "annots_df").where("id is not null")
    a = a.select("id", "image_id", F.col("category_id_1").alias("c1"), F.col("category_id_2").alias("c2"), F.col("category_id_3").alias("c3"), "bbox").distinct()
    return a.withColumn("q", from_raw(F.col("c1"))).withColumn("p", from_raw(F.col("c2")))


ANNOTS = """a AS (SELECT *, coalesce(c1, 0) + 1 AS q, coalesce(c2, 0) + 1 AS p FROM (
    SELECT DISTINCT id, image_id, category_id_1 AS c1, category_id_2 AS c2, category_id_3 AS c3, bbox FROM annots_df WHERE id IS NOT NULL))"""


def images(spark: SparkSession, sf: str) -> DataFrame:
    """The latest row of each image id. Aggregated map-side, so a hot id costs nothing."""
    cols = ["file_name", "width", "height", "source_file", "local_path"]
    i = read_table(spark, sf, "images_df").where("id is not null")
    return i.groupBy("id").agg(F.max_by(F.struct(*cols), "loaded_at").alias("s")).select("id", "s.*")


IMAGES = """i AS (SELECT id, s.* FROM (
    SELECT id, arg_max({'file_name': file_name, 'width': width, 'height': height, 'source_file': source_file, 'local_path': local_path}, loaded_at) AS s
    FROM images_df WHERE id IS NOT NULL GROUP BY id))"""


def named_annots(spark: SparkSession, sf: str) -> DataFrame:
    """annots plus diagnosis: the category's name, null for unknown ids. Of several names
    of an id the last in the alphabet counts, so that no annotation is doubled."""
    names = read_table(spark, sf, "categories").groupBy(F.col("id").alias("c3")).agg(F.max("name").alias("diagnosis"))
    return annots(spark, sf).join(names, "c3", "left")


NAMED = ANNOTS + ", n AS (SELECT a.*, c.name AS diagnosis FROM a LEFT JOIN (SELECT id, max(name) AS name FROM categories GROUP BY id) c ON c.id = a.c3)"
DIAGNOSES = ["Impacted Tooth", "Caries", "Periapical Lesion", "Deep Caries"]


def boxed(spark: SparkSession, sf: str) -> DataFrame:
    """Annotations with a box of four numbers and positive size, and their image's size."""
    i = images(spark, sf).where("width is not null and height is not null").select(F.col("id").alias("image_id"), "width", "height")
    b = annots(spark, sf).where("size(bbox) = 4 and bbox[2] > 0 and bbox[3] > 0 and bbox[0] is not null and bbox[1] is not null")
    return b.join(i, "image_id").select("id", "image_id", "q", "p", F.col("bbox")[0].alias("x"), F.col("bbox")[1].alias("y"), F.col("bbox")[2].alias("w"), F.col("bbox")[3].alias("h"), "width", "height")


BOXED = ANNOTS + ", " + IMAGES + """, b AS (
    SELECT a.id, a.image_id, a.q, a.p, a.bbox[1] AS x, a.bbox[2] AS y, a.bbox[3] AS w, a.bbox[4] AS h, i.width, i.height
    FROM a JOIN i ON i.id = a.image_id
    WHERE len(a.bbox) = 4 AND a.bbox[3] > 0 AND a.bbox[4] > 0 AND a.bbox[1] IS NOT NULL AND a.bbox[2] IS NOT NULL AND i.width IS NOT NULL AND i.height IS NOT NULL)"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Trace records once each: record_id, image_id, provider, gt, preds, turns, format_ok, tool_calls."""
    r = read_table(spark, sf, "train_cot_traces_unverified").where("record_id is not null").dropDuplicates(["record_id"])
    return r.select("record_id", "image_id", F.lower(F.trim("provider")).alias("provider"), F.col("ground_truth").alias("gt"), F.col("trajectory.final_answer").alias("preds"), F.col("trajectory.turns").alias("turns"), F.coalesce("trajectory.format_ok", F.lit(False)).alias("format_ok"), F.coalesce("trajectory.tool_calls", F.lit(0)).alias("tool_calls"))


SCORED = """t AS (
    SELECT record_id, image_id, lower(trim(provider)) AS provider, ground_truth AS gt, trajectory.final_answer AS preds, trajectory.turns AS turns,
           coalesce(trajectory.format_ok, false) AS format_ok, coalesce(trajectory.tool_calls, 0) AS tool_calls
    FROM (SELECT *, row_number() OVER (PARTITION BY record_id) AS rn FROM train_cot_traces_unverified WHERE record_id IS NOT NULL) WHERE rn = 1)"""


def first_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """scored with the first non-null finding of either side: pr, tr; records without a truth left out."""
    s = scored(spark, sf)
    return s.withColumn("pr", F.get(F.filter("preds", lambda x: x.isNotNull()), 0)).withColumn("tr", F.get(F.filter("gt", lambda x: x.isNotNull()), 0)).where("tr is not null")


FIRST = SCORED + """, f AS (SELECT * FROM (SELECT t.*, list_filter(preds, lambda x: x IS NOT NULL)[1] AS pr, list_filter(gt, lambda x: x IS NOT NULL)[1] AS tr FROM t) WHERE tr IS NOT NULL)"""
