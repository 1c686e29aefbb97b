"""Queries of the two general data-quality problems: orphan references, nested records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import place
from ..operators.nested import child_table, content_blocks, flat_tables, label_text, parent_label, shred_json
from ..operators.presence import Reference, orphans
from ..runtime import read_table

#: Children as the nested-record report names them.
CHILDREN = {
    "turns": "turns",
    "messages": "messages",
    "assistant_token_spans": "token_spans",
    "final_answer": "findings",
    "turns.tool_calls_this_turn": "tool_calls",
    "messages.content": "blocks",
}


def image_graph() -> list[Reference]:
    return [
        Reference("annots_df", "id", F.col("image_id"), "annotated_at", "images_df", "id", F.col("id"), "loaded_at", "deleted_at"),
        Reference("images_df", "id", place(F.col("local_path")), "loaded_at", "local_files", None, place(F.col("path")), "created_at", "deleted_at"),
    ]


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    return orphans({t: read_table(spark, sf, t) for t in ("annots_df", "images_df", "local_files")}, image_graph())


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf).where("kind = 'direct'").select("table_name", "record_id", "reason").distinct()


def p2_report(spark: SparkSession, sf: str) -> DataFrame:
    """Direct and inherited orphan records per table and month."""
    return (
        _orphans(spark, sf)
        .groupBy("table_name", "period")
        .agg(
            *[F.count_distinct(F.when((F.col("kind") == "direct") & (F.col("reason") == r), F.col("record_id"))).alias(r) for r in ("missing", "deleted", "late")],
            F.count_distinct(F.when(F.col("kind") == "inherited", F.col("record_id"))).alias("inherited"),
        )
    )


def p5_nodes(spark: SparkSession, sf: str) -> DataFrame:
    raw = read_table(spark, sf, "raw_trajectories").select("raw_id", "line")
    return shred_json(raw, "raw_id", "line")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    raw = read_table(spark, sf, "raw_trajectories").select("raw_id", "line")
    nodes = shred_json(raw, "raw_id", "line", values=False).where("raw_id is not null")
    names = F.create_map(*[F.lit(x) for kv in CHILDREN.items() for x in kv])
    parent = parent_label(F.col("label"))
    return nodes.select(
        "raw_id",
        names[F.col("node_table")].alias("child"),
        F.coalesce(F.element_at(parent, -1), F.lit(-1)).alias("parent_pos"),
        F.element_at("label", -1).alias("child_pos"),
    ).distinct()


def p5_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Every flat row of the raw lines with its label, its parent's label and its fields as JSON."""
    return p5_nodes(spark, sf).select("raw_id", "node_table", label_text(F.col("label")).alias("label"), label_text(parent_label(F.col("label"))).alias("parent_label"), "value").distinct()


def p5_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and records of the typed flat table of every array path that occurs in the raw
    lines, found from the lines themselves (no SQL twin: held against a brute-force
    version in the tests)."""
    tables = flat_tables(read_table(spark, sf, "raw_trajectories").select("raw_id", "line").where("raw_id is not null").distinct(), "raw_id", "line")
    counts = [t.agg(F.lit(path).alias("path"), F.count("*").alias("n"), F.count_distinct("raw_id").alias("records")) for path, t in sorted(tables.items()) if path]
    return reduce(DataFrame.unionByName, counts) if counts else spark.createDataFrame([], "path string, n long, records long")


def _p5_typed(spark: SparkSession, sf: str, table: str, kind: str) -> DataFrame:
    """A flat table of the raw lines' trajectories, wherever they are held, with typed fields."""
    nodes = p5_nodes(spark, sf).where((F.col("node_table") == table) & F.col("raw_id").isNotNull())
    typed = F.try_variant_get(F.try_parse_json("value"), "$", f"struct<{kind}>")
    return nodes.select("raw_id", label_text(F.col("label")).alias("label"), label_text(parent_label(F.col("label"))).alias("parent_label"), typed.alias("x")).select("raw_id", "label", "parent_label", "x.*").distinct()


def p5_raw_turns(spark: SparkSession, sf: str) -> DataFrame:
    return _p5_typed(spark, sf, "turns", "turn: int, raw_output: string, status: string")


def p5_raw_calls(spark: SparkSession, sf: str) -> DataFrame:
    return _p5_typed(spark, sf, "turns.tool_calls_this_turn", "tool_name: string, tool_ok: boolean, tool_error: string")


def p5_raw_messages(spark: SparkSession, sf: str) -> DataFrame:
    return _p5_typed(spark, sf, "messages", "role: string")


def p5_raw_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Content blocks; a message that is one text has it in `plain`."""
    nodes = p5_nodes(spark, sf).where("node_table = 'messages.content' and raw_id is not null")
    v = F.try_parse_json("value")
    typed = F.try_variant_get(v, "$", "struct<type: string, text: string>")
    plain = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    return nodes.select("raw_id", label_text(F.col("label")).alias("label"), label_text(parent_label(F.col("label"))).alias("parent_label"), typed.alias("x"), plain.alias("plain")).select("raw_id", "label", "parent_label", "x.type", "x.text", "plain").distinct()


def p5_raw_findings(spark: SparkSession, sf: str) -> DataFrame:
    return _p5_typed(spark, sf, "final_answer", "quadrant: int, tooth_position: int, diagnosis: string, confidence: double")


def p5_raw_token_spans(spark: SparkSession, sf: str) -> DataFrame:
    return _p5_typed(spark, sf, "assistant_token_spans", "prompt_len: int, token_ids: array<int>")


def p5_trajectory_calls(spark: SparkSession, sf: str) -> DataFrame:
    calls = child_table(read_table(spark, sf, "agent_trajectory"), "trajectory_id", ["turns", "tool_calls_this_turn"], {"tool_name": "tool_name", "tool_ok": "tool_ok", "tool_error": "tool_error"})
    return calls.distinct()


def p5_trajectory_messages(spark: SparkSession, sf: str) -> DataFrame:
    got = child_table(read_table(spark, sf, "agent_trajectory"), "trajectory_id", ["messages"], {"role": "role", "content": "content"})
    return got.select("trajectory_id", "label", "role", "content").distinct()


def p5_trajectory_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn, with calls or without."""
    got = child_table(read_table(spark, sf, "agent_trajectory"), "trajectory_id", ["turns"], {"turn": "turn", "raw_output": "raw_output", "status": "status"})
    return got.drop("parent_label").distinct()


def p5_trajectory_token_spans(spark: SparkSession, sf: str) -> DataFrame:
    got = child_table(read_table(spark, sf, "agent_trajectory"), "trajectory_id", ["assistant_token_spans"], {"prompt_len": "prompt_len", "token_ids": "token_ids"})
    return got.drop("parent_label").distinct()


def p5_trajectory_findings(spark: SparkSession, sf: str) -> DataFrame:
    fields = ("quadrant", "tooth_position", "diagnosis", "confidence")
    got = child_table(read_table(spark, sf, "agent_trajectory"), "trajectory_id", ["final_answer"], {f: f for f in fields})
    return got.drop("parent_label").distinct()


def p5_trajectory_tool_args(spark: SparkSession, sf: str) -> DataFrame:
    """The arguments of each call by name; parent_label is the call's label."""
    calls = child_table(read_table(spark, sf, "agent_trajectory"), "trajectory_id", ["turns", "tool_calls_this_turn"], {"tool_args": "tool_args"})
    return calls.select("trajectory_id", F.col("label").alias("parent_label"), F.explode("tool_args").alias("name", "value")).distinct()


def p5_trajectory_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Content blocks of each message, as p5_found counts them (no SQL twin: held against a
    brute-force version in the tests)."""
    m = p5_trajectory_messages(spark, sf).select("trajectory_id", F.col("label").alias("parent_label"), F.posexplode(content_blocks("content")).alias("at", "block")).where("block is not null")
    return m.select("trajectory_id", F.concat_ws(".", "parent_label", F.col("at").cast("string")).alias("label"), "parent_label", "block.*").distinct()


QUERIES = {
    "p2_found": p2_found,
    "p2_report": p2_report,
    "p5_found": p5_found,
    "p5_tables": p5_tables,
    "p5_paths": p5_paths,
    "p5_raw_turns": p5_raw_turns,
    "p5_raw_calls": p5_raw_calls,
    "p5_raw_messages": p5_raw_messages,
    "p5_raw_blocks": p5_raw_blocks,
    "p5_raw_findings": p5_raw_findings,
    "p5_raw_token_spans": p5_raw_token_spans,
    "p5_trajectory_calls": p5_trajectory_calls,
    "p5_trajectory_messages": p5_trajectory_messages,
    "p5_trajectory_turns": p5_trajectory_turns,
    "p5_trajectory_token_spans": p5_trajectory_token_spans,
    "p5_trajectory_findings": p5_trajectory_findings,
    "p5_trajectory_tool_args": p5_trajectory_tool_args,
    "p5_trajectory_blocks": p5_trajectory_blocks,
}

_TRIM = r"regexp_replace(regexp_replace({c}, '^[\s\p{{Z}}\x{{200B}}\x{{FEFF}}]+', ''), '[\s\p{{Z}}\x{{200B}}\x{{FEFF}}]+$', '')"


def _place_sql(c: str) -> str:
    """A path as a place, as SQL: segments folded from the left, '..' taking one off."""
    text = _TRIM.format(c=c)
    text = f"(CASE WHEN regexp_matches({text}, '^(?i)file:') THEN url_decode(regexp_replace({text}, '^(?i)file:(//)?(localhost/)?', CASE WHEN regexp_matches({text}, '^(?i)file:(//)?localhost/') THEN '/' ELSE '' END)) ELSE {text} END)"
    text = f"replace({text}, chr(92), '/')"
    fold = f"""list_reduce(list_prepend('', list_filter(string_split({text}, '/'), lambda s: s NOT IN ('', '.'))), lambda a, s: CASE WHEN s <> '..' THEN a || '/' || s WHEN a = '' AND starts_with({text}, '/') THEN a WHEN a = '' OR ends_with(a, '/..') THEN a || '/..' ELSE regexp_replace(a, '/[^/]*$', '') END)"""
    return f"(CASE WHEN {text} <> '' THEN CASE WHEN starts_with({text}, '/') THEN CASE WHEN {fold} = '' THEN '/' ELSE {fold} END ELSE substr({fold}, 2) END END)"


def _orphans_sql() -> str:
    """CTEs d (direct: tab, id, month, reason) and n (inherited: id, month)."""
    reason = "CASE WHEN count(t.k) = 0 THEN 'missing' WHEN r.w IS NULL THEN NULL WHEN count(*) FILTER (WHERE t.s <= r.w AND (t.e IS NULL OR t.e > r.w)) > 0 THEN NULL WHEN count(*) FILTER (WHERE t.s <= r.w) > 0 THEN 'deleted' ELSE 'late' END"
    side = lambda tab, refs, targets: f"SELECT '{tab}' AS tab, r.id, r.w, {reason} AS reason FROM ({refs}) r LEFT JOIN ({targets}) t ON t.k = r.k GROUP BY r.id, r.k, r.w"
    annots = side("annots_df", "SELECT DISTINCT id, image_id AS k, annotated_at AS w FROM annots_df WHERE image_id IS NOT NULL AND id IS NOT NULL", "SELECT id AS k, loaded_at AS s, deleted_at AS e FROM images_df WHERE id IS NOT NULL")
    images = side("images_df", "SELECT id, k, w FROM i WHERE k IS NOT NULL", "SELECT k, s, e FROM f WHERE k IS NOT NULL")
    return f"""i AS MATERIALIZED (SELECT DISTINCT id, {_place_sql('local_path')} AS k, loaded_at AS w FROM images_df WHERE id IS NOT NULL), f AS MATERIALIZED (SELECT {_place_sql('path')} AS k, created_at AS s, deleted_at AS e FROM local_files),
        d AS MATERIALIZED (SELECT DISTINCT tab, id, CAST(date_trunc('month', w) AS DATE) AS month, reason FROM ({annots} UNION ALL {images}) WHERE reason IS NOT NULL),
        n AS (SELECT DISTINCT id, CAST(date_trunc('month', annotated_at) AS DATE) AS month FROM annots_df WHERE image_id IN (SELECT id FROM d WHERE tab = 'images_df') AND id IS NOT NULL AND id NOT IN (SELECT id FROM d WHERE tab = 'annots_df'))"""


SQL = {
    "p2_found": f"WITH {_orphans_sql()} SELECT DISTINCT tab AS table_name, id AS record_id, reason FROM d",
    "p2_report": f"""WITH {_orphans_sql()}, x AS (SELECT tab, month, id, reason FROM d UNION ALL SELECT 'annots_df', month, id, 'inherited' FROM n)
        SELECT tab AS table_name, month AS period, {', '.join(f"count(DISTINCT id) FILTER (WHERE reason = '{r}') AS {r}" for r in ("missing", "deleted", "late", "inherited"))} FROM x GROUP BY ALL""",
    "p5_trajectory_calls": """
        WITH t AS (SELECT DISTINCT trajectory_id, turns FROM agent_trajectory WHERE turns IS NOT NULL),
        u AS (SELECT trajectory_id, generate_subscripts(turns, 1) - 1 AS i, unnest(turns) AS turn FROM t),
        c AS (SELECT trajectory_id, i, generate_subscripts(turn.tool_calls_this_turn, 1) - 1 AS j, unnest(turn.tool_calls_this_turn) AS call
              FROM u WHERE turn IS NOT NULL AND turn.tool_calls_this_turn IS NOT NULL)
        SELECT DISTINCT trajectory_id, i || '.' || j AS label, i || '' AS parent_label, call.tool_name AS tool_name, call.tool_ok AS tool_ok, call.tool_error AS tool_error
        FROM c WHERE call IS NOT NULL""",
    "p5_trajectory_messages": """
        WITH u AS (SELECT trajectory_id, generate_subscripts(messages, 1) - 1 AS i, unnest(messages) AS m FROM agent_trajectory WHERE messages IS NOT NULL)
        SELECT DISTINCT trajectory_id, i || '' AS label, m.role AS role, m.content AS content FROM u WHERE m IS NOT NULL""",
    "p5_trajectory_turns": """
        WITH u AS (SELECT trajectory_id, generate_subscripts(turns, 1) - 1 AS i, unnest(turns) AS t FROM agent_trajectory WHERE turns IS NOT NULL)
        SELECT DISTINCT trajectory_id, i || '' AS label, t.turn AS turn, t.raw_output AS raw_output, t.status AS status FROM u WHERE t IS NOT NULL""",
    "p5_trajectory_token_spans": """
        WITH u AS (SELECT trajectory_id, generate_subscripts(assistant_token_spans, 1) - 1 AS i, unnest(assistant_token_spans) AS s FROM agent_trajectory WHERE assistant_token_spans IS NOT NULL)
        SELECT DISTINCT trajectory_id, i || '' AS label, s.prompt_len AS prompt_len, s.token_ids AS token_ids FROM u WHERE s IS NOT NULL""",
    "p5_trajectory_findings": """
        WITH u AS (SELECT trajectory_id, generate_subscripts(final_answer, 1) - 1 AS i, unnest(final_answer) AS f FROM agent_trajectory WHERE final_answer IS NOT NULL)
        SELECT DISTINCT trajectory_id, i || '' AS label, f.quadrant AS quadrant, f.tooth_position AS tooth_position, f.diagnosis AS diagnosis, f.confidence AS confidence FROM u WHERE f IS NOT NULL""",
    "p5_trajectory_tool_args": """
        WITH u AS (SELECT trajectory_id, generate_subscripts(turns, 1) - 1 AS i, unnest(turns) AS t FROM agent_trajectory WHERE turns IS NOT NULL),
        c AS (SELECT trajectory_id, i, generate_subscripts(t.tool_calls_this_turn, 1) - 1 AS j, unnest(t.tool_calls_this_turn) AS call FROM u WHERE t.tool_calls_this_turn IS NOT NULL),
        e AS (SELECT trajectory_id, i || '.' || j AS parent_label, unnest(map_entries(call.tool_args)) AS e FROM c WHERE call.tool_args IS NOT NULL)
        SELECT DISTINCT trajectory_id, parent_label, e.key AS name, e.value AS value FROM e""",
}
