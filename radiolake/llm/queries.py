"""Queries of the training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import read_table
from . import bpe, groupsplit, language, mixing, overlap, pairs, survivors, truncation

# ---- p1


def _p1_winners(spark: SparkSession, sf: str) -> DataFrame:
    records = read_table(spark, sf, "train_cot_traces_unverified")
    providers = read_table(spark, sf, "providers").groupBy(F.lower(survivors.trimmed(F.col("provider"))).alias("_p")).agg(F.min("trust_rank").alias("_trust"))
    r = records.join(providers, F.lower(survivors.trimmed(F.col("provider"))) == F.col("_p"), "left")
    state = survivors.letters(F.col("status"))
    rank = F.coalesce(*[F.when(state == s, F.lit(i)) for i, s in enumerate(survivors.STATES)], F.lit(len(survivors.STATES)))
    real = {
        "status": (F.coalesce(state.isin(survivors.STATES), F.lit(False)), survivors.trimmed(F.col("status"))),
        "image_path": (survivors.has_value(F.col("image_path")), F.col("image_path")),
        "ground_truth": (survivors.has_diagnosis(F.col("ground_truth")), F.to_json("ground_truth")),
        "final_answer": (survivors.has_diagnosis(F.col("trajectory.final_answer")), F.to_json("trajectory.final_answer")),
    }
    latest = -F.unix_micros(F.col("written_at").cast("timestamp"))
    return survivors.field_winners(r, "image_id", "record_id", real, [rank, F.col("_trust"), latest, -F.col("record_id")])


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _p1_winners(spark, sf).select("image_id", "field_name", "record_id")


def p1_survivors(spark: SparkSession, sf: str) -> DataFrame:
    return survivors.survivors(_p1_winners(spark, sf), "image_id", "record_id", ["status", "image_path", "ground_truth", "final_answer"])


# ---- p3


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    t = read_table(spark, sf, "agent_trajectory").select("trajectory_id", "source", F.posexplode("messages").alias("message_pos", "m"))
    return t.where("trajectory_id is not null").select(
        F.lit("agent_trajectory").alias("table_name"), F.col("trajectory_id").alias("record_id"), "message_pos", "source", F.col("m.content").alias("text")
    )


def _p3_judged(spark: SparkSession, sf: str) -> DataFrame:
    states = read_table(spark, sf, "trace_gen_state").where("state_id is not null").select(
        F.lit("trace_gen_state").alias("table_name"), F.col("state_id").alias("record_id"), F.lit(-1).alias("message_pos"), "source", F.col("status").alias("text")
    )
    texts = _messages(spark, sf).unionByName(states).distinct()
    return truncation.judge(texts, ["table_name", "record_id", "message_pos"], "table_name")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _p3_judged(spark, sf).where("cut").select("table_name", "record_id", "message_pos").distinct()


def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per table and source: texts, cut texts, their share, and how the cuts show."""
    return (
        _p3_judged(spark, sf)
        .groupBy("table_name", "source")
        .agg(
            F.count("*").alias("texts"),
            F.count_if("cut").alias("cut_texts"),
            F.round(F.avg(F.col("cut").cast("double")), 6).alias("cut_share"),
            F.count_if(F.col("shape") == "marked").alias("marked"),
            F.count_if(F.col("shape") == "open").alias("left_open"),
        )
    )


# ---- p4


def _p4_defects(spark: SparkSession, sf: str) -> DataFrame:
    judged = truncation.judge(_messages(spark, sf).distinct(), ["table_name", "record_id", "message_pos"], "table_name")
    judged = judged.select(F.col("record_id").alias("trajectory_id"), "message_pos", "shape", "cut")
    t = read_table(spark, sf, "agent_trajectory")
    got = pairs.message_pairs(t.select("trajectory_id", "messages"), "trajectory_id", "messages")
    return pairs.defects(got.unionByName(pairs.final_answers(t, "trajectory_id", "final_answer")), "trajectory_id", judged)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.main_defect(_p4_defects(spark, sf), "trajectory_id")


def p4_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Every defect of every pair with its posterior."""
    got = _p4_defects(spark, sf)
    return got.select("trajectory_id", "question_pos", "defect", F.round("posterior", 6).alias("posterior"))


# ---- p6

SHARES = {"train": 80, "validation": 10, "test": 10}


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    occurring = read_table(spark, sf, "agent_trajectory").select("image_id").union(read_table(spark, sf, "verified_traces").select("image_id")).where("image_id is not null").distinct()
    comp = groupsplit.components(read_table(spark, sf, "id_map"), "old_image_id", "new_image_id").select(F.col("node").alias("image_id"), F.col("component").alias("group_id"))
    there = comp.join(occurring, "image_id", "left_semi")
    linked = there.groupBy("group_id").count().where("count > 1").select("group_id")
    return there.join(linked, "group_id", "left_semi").select("image_id", "group_id")


def p6_splits(spark: SparkSession, sf: str) -> DataFrame:
    t = read_table(spark, sf, "agent_trajectory").select(F.lit("agent_trajectory").alias("table_name"), F.col("trajectory_id").alias("record_id"), "image_id")
    v = read_table(spark, sf, "verified_traces").select(F.lit("verified_traces").alias("table_name"), F.col("trace_id").alias("record_id"), "image_id")
    records = t.unionByName(v).distinct()
    return groupsplit.assign_splits(records, "image_id", read_table(spark, sf, "id_map"), "old_image_id", "new_image_id", SHARES, [F.col("table_name"), F.col("record_id").cast("string")])


def p6_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Per split: records, their share, its target, and groups that lie in another split too."""
    got = p6_splits(spark, sf)
    spread = got.where("group_id is not null").groupBy("group_id").agg(F.count_distinct("split").alias("k"), F.min("split").alias("split")).groupBy("split").agg(F.count_if(F.col("k") > 1).alias("torn"))
    n = got.groupBy("split").agg(F.count("*").alias("records"))
    target = F.create_map(*[F.lit(x) for k, v in SHARES.items() for x in (k, v / 100)])
    whole = F.sum("records").over(W.partitionBy())  # three rows
    return n.join(spread, "split", "left").select("split", "records", F.round(F.col("records") / whole, 6).alias("share"), target[F.col("split")].alias("target"), F.coalesce("torn", F.lit(0)).alias("torn"))


# ---- p7


def _p7_names(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.split_names(read_table(spark, sf, "images_df"), read_table(spark, sf, "annotation_files"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    got = overlap.overlaps(_p7_names(spark, sf))
    return got.select(F.least("t_id", "e_id").alias("image_id_a"), F.greatest("t_id", "e_id").alias("image_id_b")).distinct()


def p7_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Each image's class: the images of the same canonical name and size (class id: the
    smallest image id), and how many classes of the other side are linked with it."""
    linked, own = overlap.related(_p7_names(spark, sf))
    ids = own.groupBy("name_id").agg(F.min("id").alias("class_id"))
    sides = linked.where("t_name <> e_name").select(F.col("t_name").alias("name_id"), F.col("e_name").alias("other")).unionByName(linked.where("t_name <> e_name").select(F.col("e_name").alias("name_id"), F.col("t_name").alias("other"))).distinct()
    n = sides.groupBy("name_id").agg(F.count("*").alias("links"))
    return own.join(ids, "name_id").join(n, "name_id", "left").select("id", "source_file", "split", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def p7_links(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of class representatives, one of training and one of evaluation, that show the
    same radiograph; equal ones are a class that both sides have."""
    linked, own = overlap.related(_p7_names(spark, sf))
    ids = own.groupBy("name_id").agg(F.min("id").alias("class_id"))
    t, e = (ids.withColumnsRenamed({"name_id": f"{x}_name", "class_id": f"{x}_class"}) for x in "te")
    return linked.join(t, "t_name").join(e, "e_name").select("t_class", "e_class").distinct()


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per evaluation split and source file: its images and those that training has too."""
    names = _p7_names(spark, sf)
    whole = names.where("split <> 'train'").groupBy("split", "source_file").agg(F.count_distinct("id").alias("images"))
    bad = overlap.leaked(names).groupBy(F.col("e_split").alias("split"), F.col("e_file").alias("source_file")).agg(F.count_distinct("e_id").alias("overlapping"))
    return whole.join(bad, ["split", "source_file"], "left").select("split", "source_file", "images", F.coalesce("overlapping", F.lit(0)).alias("overlapping"))


# ---- p8


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode(read_table(spark, sf, "documents"), "doc_id", "text")


# ---- p9


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    tokens = bpe.encode(read_table(spark, sf, "documents"), "doc_id", "text", ["source"])
    return mixing.mix(tokens, "doc_id", "source", "ids", read_table(spark, sf, "mix_targets"))


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares(p9_mix(spark, sf), read_table(spark, sf, "mix_targets"))


def p9_check(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the mix keeps every source's share (to one in a hundred) and its repeats."""
    return mixing.kept(p9_shares(spark, sf), read_table(spark, sf, "mix_targets"))


# ---- p10


def _p10_labelled(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "lang", "text")
    weights = language.fit(docs, "text", "lang", "doc_id")
    return language.by_company(language.label_documents(docs.withColumnRenamed("lang", "label"), "doc_id", "text", ["label"], weights), "doc_id")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return language.label_defects(_p10_labelled(spark, sf), "doc_id", "label")


def p10_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _p10_labelled(spark, sf).select("doc_id", "label", F.col("main").alias("lang"), F.round("confidence", 4).alias("confidence"))


def p10_passages(spark: SparkSession, sf: str) -> DataFrame:
    got = _p10_labelled(spark, sf).select("doc_id", F.posexplode("segs").alias("pos", "s"))
    return got.select("doc_id", "pos", "s.segment", "s.lang", F.round("s.confidence", 4).alias("confidence"))


QUERIES = {
    "p1_found": p1_found,
    "p1_survivors": p1_survivors,
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p4_found": p4_found,
    "p4_labels": p4_labels,
    "p6_found": p6_found,
    "p6_splits": p6_splits,
    "p6_shares": p6_shares,
    "p7_found": p7_found,
    "p7_classes": p7_classes,
    "p7_links": p7_links,
    "p7_report": p7_report,
    "p8_ids": p8_ids,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p9_check": p9_check,
    "p10_found": p10_found,
    "p10_documents": p10_documents,
    "p10_passages": p10_passages,
}

_NO_VALUE = ", ".join(f"'{x}'" for x in survivors.NO_VALUE)

SQL = {
    "p9_check": "SELECT source, true AS share_kept, true AS repeats_kept FROM mix_targets WHERE source IS NOT NULL GROUP BY source",
    "p1_found": rf"""
        WITH r AS (
            SELECT t.image_id, t.record_id, t.written_at, p.trust_rank,
                   regexp_replace(lower(t.status), '[^\p{{L}}]', '', 'g') AS st, t.image_path, t.ground_truth, t.trajectory.final_answer AS fa
            FROM train_cot_traces_unverified t LEFT JOIN providers p ON lower(regexp_replace(t.provider, '^\s+|\s+$', '', 'g')) = p.provider
            WHERE t.image_id IS NOT NULL AND t.record_id IS NOT NULL),
        o AS (SELECT *, CASE st WHEN 'unverified' THEN 0 WHEN 'generationfailed' THEN 1 ELSE 2 END AS rk FROM r),
        f AS (
            SELECT image_id, record_id, rk, trust_rank, written_at, 'status' AS field_name FROM o WHERE st IN ('unverified', 'generationfailed')
            UNION ALL SELECT image_id, record_id, rk, trust_rank, written_at, 'image_path' FROM o WHERE lower(regexp_replace(image_path, '^\s+|\s+$', '', 'g')) NOT IN ({_NO_VALUE})
            UNION ALL SELECT image_id, record_id, rk, trust_rank, written_at, 'ground_truth' FROM o WHERE len(list_filter(ground_truth, lambda x: lower(trim(x.diagnosis)) NOT IN ({_NO_VALUE}))) > 0
            UNION ALL SELECT image_id, record_id, rk, trust_rank, written_at, 'final_answer' FROM o WHERE len(list_filter(fa, lambda x: lower(trim(x.diagnosis)) NOT IN ({_NO_VALUE}))) > 0),
        n AS (SELECT image_id FROM r GROUP BY image_id HAVING count(DISTINCT record_id) > 1)
        SELECT image_id, field_name, record_id FROM (
            SELECT *, row_number() OVER (PARTITION BY image_id, field_name ORDER BY rk, trust_rank NULLS LAST, written_at DESC NULLS LAST, record_id DESC) AS rn
            FROM f WHERE image_id IN (SELECT image_id FROM n)) WHERE rn = 1""",
    "p6_found": """
        WITH RECURSIVE e AS (SELECT DISTINCT old_image_id AS a, new_image_id AS b FROM id_map WHERE old_image_id IS NOT NULL AND new_image_id IS NOT NULL AND old_image_id <> new_image_id),
        u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        w AS (SELECT DISTINCT a AS node, a AS reach FROM u UNION SELECT w.node, u.b FROM w JOIN u ON u.a = w.reach),
        c AS (SELECT node, min(reach) AS group_id FROM w GROUP BY node),
        o AS (SELECT DISTINCT image_id FROM (SELECT image_id FROM agent_trajectory UNION ALL SELECT image_id FROM verified_traces) WHERE image_id IS NOT NULL),
        k AS (SELECT o.image_id, c.group_id FROM o JOIN c ON c.node = o.image_id)
        SELECT image_id, group_id FROM k WHERE group_id IN (SELECT group_id FROM k GROUP BY group_id HAVING count(*) > 1)""",
}
