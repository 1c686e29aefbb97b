"""Append-only logs: JSON lines, training logs, file listings, the dataset catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..runtime import path_exists

FINDING = "struct<quadrant: int, tooth_position: int, diagnosis: string, bbox: array<double>>"
ANSWER = "struct<quadrant: int, tooth_position: int, diagnosis: string, confidence: double>"
CALL = "struct<tool_name: string, tool_args: map<string, string>, tool_ok: boolean, tool_error: string>"
TURN = f"struct<turn: int, raw_output: string, status: string, tool_calls_this_turn: array<{CALL}>>"
TRAJECTORY = f"struct<turns: array<{TURN}>, tool_calls: int, final_answer: array<{ANSWER}>, messages: array<struct<role: string, content: string>>, format_ok: boolean>"
TRACE = f"image_id bigint, image_path string, status string, provider string, ground_truth array<{FINDING}>, trajectory {TRAJECTORY}, failure_reason string"


def read_lines(spark: SparkSession, path: str, schema: str, stream: bool = False) -> DataFrame:
    """JSON lines of a schema; blank and damaged lines are skipped."""
    full = StructType.fromDDL(schema).add("_corrupt", "string")
    lines = (spark.readStream if stream else spark.read).text(path)
    parsed = lines.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("x"))
    return parsed.where("x is not null and x._corrupt is null").select("x.*").drop("_corrupt")


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Traces of a JSON-lines file, or of one JSON array; a missing .json gives way to
    its .jsonl twin."""
    if path.endswith(".json") and not path_exists(spark, path) and path_exists(spark, path + "l"):
        path += "l"
    if path.endswith(".json"):
        return spark.read.schema(TRACE).option("multiLine", True).json(path)
    return read_lines(spark, path, TRACE)


def append_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def completed(log: DataFrame) -> DataFrame:
    """image_id of the traces that need no new run: failures are tried again."""
    return log.where("image_id is not null and status <> 'generation_failed'").select("image_id").distinct()


def training_log(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of epochs, header names trimmed, every measure a double."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    return raw.select(*[F.col(f"`{c}`").cast("double").alias(c.strip()) for c in raw.columns])


def last_epoch(log: DataFrame, epoch: str = "epoch", by: list[str] | None = None) -> DataFrame:
    """The row of the highest epoch, of each group if there are any."""
    return log.groupBy(*(by or [])).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in log.columns]), epoch).alias("s")).select("s.*")


def append_results(df: DataFrame, path: str) -> None:
    """Results added to a log as they come: nothing that is there is written again."""
    df.write.mode("append").parquet(path)


def read_results(spark: SparkSession, path: str, schema: str, key: str, at: str) -> DataFrame:
    """The latest result of each key of a log; a log that isn't there is empty."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    log = spark.read.schema(schema).parquet(path)
    return log.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c != key]), at).alias("_s")).select(key, "_s.*")


def image_listing(spark: SparkSession, root: str, pattern: str = "*.{png,jpg,jpeg,bmp,gif}") -> DataFrame:
    """path, length and, from the bytes' head, the kind, width, height and colour mode of
    image files. Bytes that are no image give nulls."""
    from ..functions.images import header

    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return f.select("path", "length", header(F.col("content")).alias("h")).select("path", "length", "h.*")


# Public datasets of panoramic films (name, images, country, license, annotations, registration, address).
CATALOG = [
    ("DENTEX", 2332, "Switzerland", "unspecified", "label", False, "https://zenodo.org/records/7812323"),
    ("Tufts Panoramic Dataset", 1000, "United States", "unspecified", "label", True, "https://tdd.ece.tufts.edu/"),
    ("Dental Radiography", 1272, "Iran", "CC BY-SA 4.0", "unspecified", False, "https://www.kaggle.com/datasets/imtkaggleteam/dental-radiography"),
    ("Panoramic Dental Xray Dataset", 180, "Tunisia", "CC BY 4.0", "pixel level", False, "https://data.mendeley.com/datasets/73n3kz2k4k/2"),
    ("Panoramic-Caries-Segmentation", 75, "China", "unspecified", "pixel level", False, "https://github.com/Zzz512/MLUA"),
    ("TK_Tooth_Number_Code", 188, "unspecified", "unspecified", "label", False, "https://github.com/tanjidakabir/TK_Tooth_Number_Code"),
    ("Panoramic Dental X-rays With Segmented Mandibles", 232, "Iran", "CC BY-NC 3.0", "pixel level", False, "https://data.mendeley.com/datasets/hxt48yk462/2"),
    ("Panoramic-Paraguay", 135, "Paraguay", "unspecified", "unspecified", False, "https://zenodo.org/records/4457648"),
]


def catalog(spark: SparkSession) -> DataFrame:
    """The datasets that the loaders know of, all of panoramic films."""
    rows = spark.createDataFrame(CATALOG, "name string, n_images int, country string, license string, annotation_type string, registration_required boolean, url string")
    return rows.withColumn("modality", F.lit("panoramic")).withColumn("notes", F.lit(""))


def catalog_lines(spark: SparkSession) -> DataFrame:
    """A line to each dataset."""
    need = F.when(F.col("registration_required"), "registration required").otherwise("no registration")
    line = F.concat(F.lit("  - "), "name", F.lit(": "), F.col("n_images").cast("string"), F.lit(" images, "), "country", F.lit(", "), "license", F.lit(", "), need)
    return catalog(spark).select(line.alias("line"))
