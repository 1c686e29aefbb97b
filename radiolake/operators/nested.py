"""Nested records as flat tables under Dewey labels.

Every array element is a node. Its label is the list of zero-based positions of
the arrays on its way from the root, its table the schema path without positions
('turns.tool_calls_this_turn'). The parent's label is the label without its last
part: links need no join and no generated key.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType, VariantType

from ..runtime import cut_lineage

NODE = "node_table string, label array<int>, value string"

#: Arrays of a trajectory, by field; the nested dict has the arrays of the elements.
TRAJECTORY = {
    "turns": {"tool_calls_this_turn": {}},
    "messages": {"content": {}},
    "assistant_token_spans": {},
    "final_answer": {},
}
HOLDERS = ("trajectory", "partial_trajectory")


def parsed_object(text: str | None, unwraps: int = 2) -> dict | None:
    """The JSON object that text is, or that it holds as JSON text; else None."""
    for _ in range(unwraps + 1):
        if not isinstance(text, str):
            break
        try:
            text = json.loads(text.lstrip("﻿ \t\r\n"))
        except (ValueError, RecursionError):
            return None
    return text if isinstance(text, dict) else None


def held_object(root: dict, holders: tuple[str, ...] = HOLDERS) -> dict:
    for name in holders:
        inner = root.get(name)
        inner = inner if isinstance(inner, dict) else parsed_object(inner)
        if inner is not None:
            return inner
    return root


def dewey_nodes(root: dict, arrays: dict) -> Iterator[tuple[str, list[int], object]]:
    """(table, label, element) of every array element, parents before children."""
    stack = [("", [], root, arrays)]
    while stack:
        prefix, label, node, shape = stack.pop()
        if not isinstance(node, dict):
            continue
        for field, inner in shape.items():
            value = node.get(field)
            if value is None:
                continue
            table = f"{prefix}{field}"
            for i, element in enumerate(value if isinstance(value, list) else [value]):
                if element is None:
                    continue
                at = [*label, i]
                yield table, at, element
                if inner:
                    stack.append((table + ".", at, element, inner))


def shred_json(df: DataFrame, key: str, text: str, arrays: dict | None = None, holders: tuple[str, ...] = HOLDERS, values: bool = True) -> DataFrame:
    """key, node_table, label, value for every array element in the JSON text column.

    A lone object or text in place of an array counts as an array of one, a null
    entry keeps its place but gives no row. Text that is no complete JSON object
    (null, empty, damaged, a bare list) gives no rows. value is the element as JSON
    without its own child arrays; values=False leaves it null.
    Rows are independent, so there is no shuffle and no group to outgrow a task. The
    lines are read in Python: variants in the JVM took four times as long for the same.
    """
    arrays = TRAJECTORY if arrays is None else arrays
    kind = df.schema[key].dataType.simpleString()

    def flat(element: object, table: str) -> str:
        if isinstance(element, dict):
            shape = arrays
            for part in table.split("."):
                shape = shape[part]
            element = {k: v for k, v in element.items() if k not in shape}
        return json.dumps(element, ensure_ascii=False)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for k, line in zip(batch[key].tolist(), batch[text].tolist()):
                root = parsed_object(line)
                if root is None:
                    continue
                for table, label, element in dewey_nodes(held_object(root, holders), arrays):
                    out.append((k, table, label, flat(element, table) if values else None))
            yield pd.DataFrame(out, columns=[key, "node_table", "label", "value"])

    return df.select(key, text).where(F.col(text).isNotNull()).mapInPandas(run, f"{key} {kind}, {NODE}")


def _is_null(v: Column) -> Column:
    return v.isNull() | F.is_variant_null(v)


def whole_object(text: Column, unwraps: int = 2) -> Column:
    """The JSON object that a text is, or holds as JSON text, as a variant; null for any
    other. Between brackets trailing text makes the JSON bad, and a second value a
    second element."""
    def one(t: Column) -> Column:
        v = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), t, F.lit("]"))), "$", "array<variant>")
        return F.when(F.size(v) == 1, F.get(v, 0))

    # Each step's variant is bound once, as the element of an array of one.
    step = F.array(one(text))
    for _ in range(unwraps):
        again = lambda v: F.when(F.schema_of_variant(v) == "STRING", one(F.try_variant_get(v, "$", "string"))).otherwise(v)
        step = F.transform(step, again)
    return F.get(F.filter(step, lambda v: F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))), 0)


def elements(value: Column) -> Column:
    """A variant's elements; a lone value in place of an array counts as an array of one."""
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.when(~_is_null(value), F.array(value)), F.array().cast("array<variant>"))


# ---- tables by discovered path


def _typed(told: str) -> DataType:
    """The merged type of many variants as they tell it. What differs between them (text
    here, an array there) stays a variant; what is null in all is text."""
    return DataType.fromDDL(re.sub(r"\bOBJECT<", "STRUCT<", told).replace("VOID", "STRING"))


def _fields(kind: DataType, at: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], DataType]]:
    """The fields of a type through its objects, by their paths."""
    if isinstance(kind, StructType):
        for f in kind:
            yield from _fields(f.dataType, (*at, f.name))
    else:
        yield at, kind


def _at(v: Column, fields: tuple[str, ...]) -> Column:
    for f in fields:
        own = F.when(F.schema_of_variant(v).startswith("OBJECT"), v)
        v = F.try_variant_get(own, "$['" + f.replace("'", "\\'") + "']", "variant")
    return v


def _ddl(kind: DataType) -> str:
    return "string" if isinstance(kind, StringType) else kind.simpleString()


def flat_tables(df: DataFrame, key: str, text: str) -> dict[str, DataFrame]:
    """A typed flat table for every array that occurs anywhere in the JSON objects of a text
    column, by its schema path ('turns.tool_calls_this_turn'; '[]' for arrays in arrays), and
    the root's own fields under ''.

    A table has key, label, parent_label and its elements' fields, those of nested objects
    by their path; elements that are no objects have their value in `value`. A label's
    places are those of the arrays on the way, so cutting off the last gives the parent's.
    A field that is an array in some rows and a lone value in others is an array of one
    there; one of several plain types is JSON text. Texts that are no JSON object have no
    rows, null entries keep their place. The types of a table are found by one
    aggregation over all its rows: passes grow with the paths, not with the rows.
    """
    out: dict[str, DataFrame] = {}
    label = [label_text(F.col("_label")).alias("label"), label_text(parent_label(F.col("_label"))).alias("parent_label")]

    def walk(path: tuple[str, ...], cur: DataFrame) -> None:
        kind = F.schema_of_variant("_v")
        is_object, is_array = F.startswith(kind, F.lit("OBJECT")), F.startswith(kind, F.lit("ARRAY"))
        told = cur.agg(*[F.schema_of_variant_agg(F.when(c, F.col("_v"))) for c in (is_object, ~is_object & ~is_array)], F.count_if(is_array)).first()
        found = list(_fields(_typed(told[0]))) if told[0] != "VOID" else []
        mixed = [f for f, t in found if isinstance(t, VariantType)]
        lists = [f for f, t in found if isinstance(t, ArrayType)]
        if mixed:
            holds = cur.agg(*[F.bool_or(F.coalesce(F.startswith(F.schema_of_variant(_at(F.col("_v"), f)), F.lit("ARRAY")), F.lit(False))).alias(f"c{i}") for i, f in enumerate(mixed)]).first()
            lists += [f for i, f in enumerate(mixed) if holds[i]]
        columns = []
        for f, t in found:
            if f not in lists:
                v = _at(F.col("_v"), f)
                columns.append((F.when(~_is_null(v), F.to_json(v)) if isinstance(t, VariantType) else F.try_variant_get(v, "$", _ddl(t))).alias(".".join(f)))
        if told[1] != "VOID":
            t = _typed(told[1])
            columns.append(F.when(~is_object & ~is_array, F.to_json("_v") if isinstance(t, VariantType) else F.try_variant_get("_v", "$", _ddl(t))).alias("value"))
        out[".".join(path)] = cur.select(F.col("_key").alias(key), *(label if path else []), *columns)
        inner = [(f, F.try_variant_get(_at(F.col("_v"), f), "$", "array<variant>") if f not in mixed else elements(_at(F.col("_v"), f))) for f in lists]
        if told[2]:
            inner.append((("[]",), F.try_variant_get("_v", "$", "array<variant>")))
        for f, items in inner:
            child = cur.select("_key", "_label", F.posexplode(items).alias("_p", "_e")).where("_e is not null and not is_variant_null(_e)")
            walk((*path, *f), child.select("_key", F.concat("_label", F.array("_p")).alias("_label"), F.col("_e").alias("_v")))

    # Every table's types are looked up before it is planned, so the lines are parsed once for all.
    shaped = cut_lineage(df.select(F.col(key).alias("_key"), F.array().cast("array<int>").alias("_label"), whole_object(F.col(text)).alias("_v")).where("_v is not null"))
    walk((), shaped)
    return out


def rebuilt(children: DataFrame, key: str, value: Column) -> DataFrame:
    """key, parent_label, items: the elements of a flat table as their parents' arrays again,
    in their places; null entries between them are null again. The inverse of the cut:
    joined to the parents' labels it gives back the records."""
    at = F.element_at(F.split("label", r"\."), -1).cast("int")
    got = children.select(key, "parent_label", F.struct(at.alias("at"), value.alias("v")).alias("x")).groupBy(key, "parent_label").agg(F.array_sort(F.collect_list("x")).alias("x"))
    places = F.sequence(F.lit(0), F.element_at("x", -1)["at"])
    by_place = F.map_from_entries("x")
    return got.select(key, "parent_label", F.transform(places, lambda i: by_place[i]).alias("items"))


def parent_label(label: Column) -> Column:
    """The parent's label: the label cut by its last part; null for a root's child."""
    return F.when(F.size(label) > 1, F.slice(label, 1, F.greatest(F.size(label) - 1, F.lit(1))))


def label_text(label: Column) -> Column:
    return F.array_join(label.cast("array<string>"), ".")


def child_table(df: DataFrame, key: str, arrays: list[str], columns: dict[str, str] | None = None) -> DataFrame:
    """The flat table at the end of a path of typed array columns, JVM-side.

    arrays names the array of the row, then the array within its elements, and so
    on. Gives key, label, parent_label and the element's fields (or the given
    columns: name -> field path). Null arrays and null entries give no rows.
    """
    cur = df.select(F.col(key), F.col(arrays[0]).alias("_a"), F.array().cast("array<int>").alias("_label"))
    for depth, _ in enumerate(arrays):
        cur = cur.select(key, "_label", F.posexplode("_a").alias("_p", "_e")).where("_e is not null")
        cur = cur.select(key, F.concat("_label", F.array("_p")).alias("_label"), "_e")
        if depth + 1 < len(arrays):
            cur = cur.select(key, "_label", F.col(f"_e.{arrays[depth + 1]}").alias("_a"))
    fields = [F.col(f"_e.{path}").alias(name) for name, path in columns.items()] if columns else [F.col("_e.*")]
    return cur.select(F.col(key), label_text(F.col("_label")).alias("label"), label_text(parent_label(F.col("_label"))).alias("parent_label"), *fields)


def _storable(s: object) -> str | None:
    """s if it is text, without lone surrogates, which Arrow can't hold."""
    return s.encode("utf-8", "replace").decode() if isinstance(s, str) else None


def blocks_of(content: str | None) -> list[tuple | None] | None:
    """(type, text, value) of each content block, value being the block as JSON; a null entry
    is None. Text that is no JSON array counts as an array of one text."""
    if content is None:
        return None
    try:
        blocks = json.loads(content)
    except (ValueError, RecursionError):
        blocks = None
    if not isinstance(blocks, list):
        return [(None, content, None)]
    out: list[tuple | None] = []
    for b in blocks:
        kind, text = (b.get("type"), b.get("text")) if isinstance(b, dict) else (None, b)
        out.append(None if b is None else (_storable(kind), _storable(text), _storable(json.dumps(b, ensure_ascii=False))))
    return out


@F.pandas_udf(ArrayType(StructType([StructField(n, StringType()) for n in ("type", "text", "value")])))
def content_blocks(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in contents:
        yield batch.map(lambda c: (b := blocks_of(c)) and [x and dict(zip(("type", "text", "value"), x)) for x in b]).astype(object)
