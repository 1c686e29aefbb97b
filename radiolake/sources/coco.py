"""Annotation documents (images, annotations, categories in one JSON) as tables, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import basename, dirname
from ..operators.ranking import id_ranges, running_total
from ..runtime import path_exists

DOCUMENT = """images array<struct<id: bigint, file_name: string, width: int, height: int>>,
    annotations array<struct<id: bigint, image_id: bigint, category_id_1: int, category_id_2: int, category_id_3: int, bbox: array<double>>>,
    categories array<struct<id: int, name: string>>, _corrupt string"""
#: Places of a file numbered in one task when files are put together.
RANGE = 4096
KEYS = ("category_id_1", "category_id_2", "category_id_3", "bbox")


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """Every readable document below root with its path; unreadable files are skipped."""
    raw = (
        spark.read.schema(DOCUMENT)
        .option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
        .json(root)
    )
    named = raw.withColumn("path", F.url_decode(F.regexp_replace(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"), r"^file:(//)?", "")))
    return named.where("_corrupt is null and (images is not null or annotations is not null)").drop("_corrupt")


def summary(documents: DataFrame, root: str) -> DataFrame:
    """Per file: counts and the first eight category names."""
    names = F.array_join(F.transform(F.slice(F.coalesce("categories", F.array()), 1, 8), lambda c: c["name"]), ", ")
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    return documents.select(F.replace("path", F.lit(root.rstrip("/") + "/"), F.lit("")).alias("file"), count("images").alias("images"), count("annotations").alias("annotations"), count("categories").alias("categories"), names.alias("names"))


def score(documents: DataFrame, split: str) -> DataFrame:
    """path, score of each document as the source of a split."""

    def has(key: str) -> Column:
        return F.exists(F.coalesce("annotations", F.array()), lambda a: a[key].isNotNull()).cast("int")

    present = sum((has(k) for k in KEYS), F.lit(0))
    low = F.lower("path")
    return documents.select("path", (F.when(low.contains(split), 2).otherwise(0) + present + F.when(low.rlike("diagnosis|disease|triple"), 2).otherwise(0)).alias("score"))


def best(documents: DataFrame, split: str) -> str:
    """The path with the highest score, the first of equals. Raises if there is none."""
    row = score(documents, split).orderBy(F.col("score").desc(), "path").first()
    if row is None:
        raise ValueError("no readable annotation document")
    return row["path"]


def tables(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, categories) of one or more documents, re-keyed: images of
    all files get ids 1 .. N by file and place, annotations follow their own file's
    images and fall away without one, categories come from the first file that has any."""
    i = documents.select("path", F.posexplode("images").alias("at", "x")).select("path", "at", F.col("x.id").alias("old_id"), "x.file_name", "x.width", "x.height")
    i = running_total(i, [], ["path", "at"], F.lit(1), "before", bucket=F.struct("path", F.floor(F.col("at") / RANGE))).withColumn("id", (F.col("before") + 1).cast("bigint"))
    a = documents.select("path", F.posexplode("annotations").alias("at", "x")).select("path", "at", "x.*")
    first = i.groupBy("path", F.col("old_id").alias("image_id")).agg(F.min("id").alias("new_id"))
    a = a.join(first, ["path", "image_id"]).select("id", F.col("new_id").alias("image_id"), *KEYS, F.col("path").alias("source_file"), F.col("at").alias("ord"))
    with_names = documents.where(F.size("categories") > 0).agg(F.min_by("categories", "path").alias("c"))
    images = i.select("id", "file_name", "width", "height", F.col("path").alias("source_file"))
    return images, a, with_names.select(F.inline("c"))


def load(spark: SparkSession, root: str, split: str, combine: bool = False, cache: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables of the best document of a split, or of all of them combined.
    With cache, they are read from there if all three are, else written there."""
    names = ("images", "annotations", "categories")
    if cache and all(path_exists(spark, f"{cache}/{n}.parquet") for n in names):
        return tuple(spark.read.parquet(f"{cache}/{n}.parquet") for n in names)
    documents = read_documents(spark, root)
    if not combine:
        documents = documents.where(F.col("path") == best(documents, split))
    got = tables(documents)
    if cache:
        for n, df in zip(names, got):
            df.write.mode("overwrite").parquet(f"{cache}/{n}.parquet")
        return tuple(spark.read.parquet(f"{cache}/{n}.parquet") for n in names)
    return got


def resolved(images: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """images plus local_path: the file beside its document, in the folder for films
    there, or the last file of the same name; null if there is none."""
    listing = files.select(F.col(path).alias("p")).distinct()
    by_name = listing.groupBy(basename(F.col("p")).alias("_base")).agg(F.max("p").alias("_named"))
    folder = dirname(F.col("source_file"))
    wanted = images.withColumn("_e", F.concat_ws("/", folder, F.col("file_name"))).withColumn("_x", F.concat_ws("/", folder, F.lit("xrays"), basename(F.col("file_name")))).withColumn("_base", basename(F.col("file_name")))
    hit = lambda c: listing.select(F.col("p").alias(c), F.col("p").alias(f"{c}_hit"))
    j = wanted.join(hit("_e"), "_e", "left").join(hit("_x"), "_x", "left").join(by_name, "_base", "left")
    return j.withColumn("local_path", F.coalesce("_e_hit", "_x_hit", "_named")).drop("_e", "_x", "_e_hit", "_x_hit", "_base", "_named")


def usable_path(c: Column) -> Column:
    return c.isNotNull() & (c != "None")


def document(images: DataFrame, annotations: DataFrame, categories: DataFrame, file: str = "source_file", most: int = 50_000) -> DataFrame:
    """file, shard, json: the tables as documents again. A file with more than `most` images
    goes on in further shards, each with its own images and their annotations, so what
    one document holds is bounded by that and by its images' annotations. Categories are
    in every document; they are few by their nature."""
    numbered = running_total(images, [file], ["id"], F.lit(1), "_at", bucket=id_ranges(images, "id")).withColumn("shard", F.floor(F.col("_at") / most))
    i = numbered.groupBy(file, "shard").agg(F.sort_array(F.collect_list(F.struct("id", "file_name", "width", "height"))).alias("images"))
    placed = annotations.join(numbered.select(F.col("id").alias("image_id"), file, "shard"), ["image_id", file])
    a = placed.groupBy(file, "shard").agg(F.sort_array(F.collect_list(F.struct("id", "image_id", *KEYS))).alias("annotations"))
    c = categories.agg(F.sort_array(F.collect_list(F.struct("id", "name"))).alias("c")).scalar()
    whole = i.join(a, [file, "shard"], "left").withColumn("categories", c)
    return whole.select(file, "shard", F.to_json(F.struct("images", F.coalesce("annotations", F.array()).alias("annotations"), "categories")).alias("json"))


def enumerated(documents: DataFrame, split: str) -> DataFrame:
    """The documents of a split that number their teeth: the path tells of the split, and
    the first annotation has quadrant and position."""
    first = F.get("annotations", 0)
    return documents.where(F.lower("path").contains(split[:3] if split == "validation" else split) & first["category_id_1"].isNotNull() & first["category_id_2"].isNotNull())


def find_root(spark: SparkSession, candidates: list[str], split: str) -> str | None:
    """The first folder that has the split's data folder and one of its documents, or None."""
    train = split.startswith("train")
    folder, names = ("training_data", ("train", "disease", "triple")) if train else ("validation_data", ("val", "validation_triple"))
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for c in candidates:
        at = jvm.org.apache.hadoop.fs.Path(c)
        system = at.getFileSystem(conf)
        if not system.exists(at) or not system.getFileStatus(at).isDirectory():
            continue
        inside = [s.getPath().getName() for s in system.listStatus(at) if s.isDirectory()]
        files = system.listFiles(at, True)
        found = False
        while files.hasNext() and not found:
            name = files.next().getPath().getName()
            found = name.endswith(".json") and any(n in name for n in names)
        if found and any(folder in n for n in inside):
            return c
    return None
