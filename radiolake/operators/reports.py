"""Small results written out: metric tables, label files, run notes. What is collected
here is a handful of aggregated rows."""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import store

# Columns of the summary and their headings.
HEADINGS = {
    "format_adherence": "Format", "fdi_localization_accuracy": "FDI", "pathology_macro_f1": "Macro F1",
    "exact_match_accuracy": "Exact", "exact_match_ci_95": "95 % CI", "ece": "ECE", "mean_tool_calls": "Calls",
}


def cell(v: object) -> str:
    if v is None:
        return "–"
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(f"{x:.3f}" for x in v) + "]"
    return f"{v:.3f}" if isinstance(v, float) else str(v)


def summary_table(rows: dict[str, dict], style: str = "github") -> str:
    """Methods against metrics, as a Markdown or LaTeX table."""
    head = ["Method", *HEADINGS.values()]
    body = [[m, *[cell(r.get(c)) for c in HEADINGS]] for m, r in rows.items()]
    if style == "latex":
        lines = [" & ".join(x).replace("%", r"\%") + r" \\" for x in [head, *body]]
        return "\n".join([r"\begin{tabular}{l" + "r" * len(HEADINGS) + "}", lines[0], r"\hline", *lines[1:], r"\end{tabular}"])
    if style != "github":
        raise ValueError(f"no such table style: {style}")
    return "\n".join("| " + " | ".join(x) + " |" for x in [head, ["---"] * len(head), *body])


def write_report(rows: dict[str, dict], folder: str, title: str = "Results") -> None:
    """metrics.json (by method) and report.md in a folder of any file system."""
    store(f"{folder}/metrics.json", json.dumps(rows, indent=2, ensure_ascii=False).encode())
    store(f"{folder}/report.md", f"# {title}\n\n{summary_table(rows)}\n".encode())


def failure_log(df: DataFrame, path: str, category: str = "category") -> None:
    df.write.mode("overwrite").partitionBy(category).json(path)


def label_lines(labels: DataFrame) -> DataFrame:
    """image_id, text: one label file's lines 'class cx cy w h' per image, by class. An
    image has as many lines as boxes; images without boxes have no row."""
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "label_class", "cx", "cy", "nw", "nh")
    return labels.groupBy("image_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("label_class", "id", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))


def label_names(spark: SparkSession) -> dict[int, str]:
    """Class numbers and names (two-digit codes) of the 32 teeth."""
    rows = spark.range(32).select(F.col("id").cast("int"), ((F.floor(F.col("id") / 8) + 1) * 10 + F.col("id") % 8 + 1).cast("string").alias("name")).collect()
    return {r[0]: r[1] for r in rows}


def dataset_note(spark: SparkSession, root: str) -> str:
    """The dataset description that label-file trainers read."""
    names = "\n".join(f"  {k}: '{v}'" for k, v in sorted(label_names(spark).items()))
    return f"path: {root}\ntrain: images/train\nval: images/val\nnames:\n{names}\n"


def run_note(folder: str, name: str, **facts: object) -> None:
    """Facts of a run with the time, as a JSON file of its own in a folder."""
    store(f"{folder}/{name}.json", json.dumps({"timestamp": time.strftime("%Y-%m-%dT%H:%M:%S"), **facts}, default=str).encode())


def run_notes(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The notes of a folder, one row each."""
    return spark.read.schema(schema).json(folder)


def latest(df: DataFrame, name: str, at: str) -> DataFrame:
    """The checkpoint with the latest time, not the last name."""
    return df.agg(F.max_by(name, at).alias(name), F.max(at).alias(at))


def jsonable(df: DataFrame, sets: list[str] | None = None) -> DataFrame:
    """Each row as JSON text in which equal rows are equal text: arrays that stand for sets
    (all arrays of plain values unless named) are sorted by their text, images (binary)
    become a mark."""

    def plain(f: T.StructField) -> Column:
        c, kind = F.col(f"`{f.name}`"), f.dataType
        if isinstance(kind, T.BinaryType):
            return F.when(c.isNotNull(), F.lit("<Image>")).alias(f.name)
        if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.ArrayType, T.StructType, T.MapType)) and (sets is None or f.name in sets):
            by_text = F.array_sort(F.transform(c, lambda x: F.struct(x.cast("string").alias("t"), x.alias("x"))))
            return F.transform(by_text, lambda x: x["x"]).alias(f.name)
        return c.alias(f.name)

    return df.select(F.to_json(F.struct(*[plain(f) for f in df.schema])).alias("json"))
