"""Queries over replies, trace logs, call logs and small literal tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import budget, text
from ..operators import limits, scoring, traces
from ..operators.ranking import running_total
from ..runtime import read_table
from ..sources.logs import CATALOG, catalog
from .base import ANNOTS, IMAGES, SCORED, annots, images, scored

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _replies(spark: SparkSession, sf: str) -> DataFrame:
    """Trace documents as replies, wrapped in thinking blocks, fences or cut off by id."""
    d = read_table(spark, sf, "documents").where("doc_id is not null and text is not null")
    k = F.col("doc_id") % 5
    body = F.concat(F.lit('{"thought": '), F.regexp_extract(F.to_json(F.struct(F.col("text").alias("t"))), r'(?s)^\{"t":(.*)\}$', 1), F.lit(', "tool": "denoise", "args": {"method": "median"}}'))
    listed = F.concat(F.lit('{"thought": '), F.regexp_extract(F.to_json(F.struct(F.col("text").alias("t"))), r'(?s)^\{"t":(.*)\}$', 1), F.lit(', "tool_calls": [{"tool": "denoise", "args": {"method": "median"}}]}'))
    think = F.concat(F.lit("<think>as before</think>"), body)
    cut = body.substr(F.lit(1), F.length(body) - 9)
    reply = F.when(k == 0, listed).when(k == 1, think).when(k == 2, F.concat(F.lit("So:\n```json\n"), body, F.lit("\n```"))).when(k == 3, cut).otherwise(F.col("text"))
    return d.select("doc_id", "text", k.alias("k"), reply.alias("reply"))


@query("""WITH d AS (SELECT doc_id, text, doc_id % 5 AS k FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL AND doc_id % 5 < 4)
    SELECT doc_id, 'denoise' AS tool, CASE WHEN k = 3 THEN '' ELSE 'median' END AS method, CASE WHEN contains(text, '<think>') OR contains(text, '```') THEN NULL ELSE length(text) END AS thought FROM d""")
def agent_json_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Replies to actions: every text of the documents as the thought of an action, bare,
    behind a thinking block, in a fence, or cut off in its arguments. What a text with
    such marks of its own leaves of the thought isn't told."""
    marks = F.contains("text", F.lit("<think>")) | F.contains("text", F.lit("```"))
    a = _replies(spark, sf).where("k < 4").select("doc_id", marks.alias("marks"), F.try_parse_json(text.action_json(F.col("reply"))).alias("v"))
    said = F.length(F.try_variant_get("v", "$.thought", "string"))
    return a.select("doc_id", F.try_variant_get("v", "$.tool_calls[0].tool", "string").alias("tool"), F.try_variant_get("v", "$.tool_calls[0].args.method", "string").alias("method"), F.when(~F.col("marks"), said).cast("bigint").alias("thought"))


@query()
def agent_text_parse(spark: SparkSession, sf: str) -> DataFrame:
    """The actions that the documents' own texts hold, if any (no SQL twin: held against a
    brute-force version in the tests)."""
    d = read_table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", text.action_json(F.col("text")).alias("action")).where("action is not null")


@query("SELECT doc_id, trim(regexp_replace(t, '<think>.*?</think>', '', 'gis'), chr(32)) AS rest FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '<think>' || text || '</think>' || coalesce(lang, '') ELSE text END AS t FROM documents WHERE text IS NOT NULL)")
def think_strip(spark: SparkSession, sf: str) -> DataFrame:
    t = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<think>"), F.col("text"), F.lit("</think>"), F.coalesce("lang", F.lit("")))).otherwise(F.col("text"))
    return read_table(spark, sf, "documents").where("text is not null").select("doc_id", text.without_thinking(t).alias("rest"))


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    """Messages with content once each; i counts from 1."""
    m = read_table(spark, sf, "agent_trajectory").select("trajectory_id", F.posexplode("messages").alias("i", "m"))
    return m.select("trajectory_id", (F.col("i") + 1).alias("i"), F.col("m.content").alias("content")).where("content is not null").distinct()


@query()
def format_reward(spark: SparkSession, sf: str) -> DataFrame:
    """Every message with content, two thirds of them behind a thinking block (no SQL twin:
    held against a brute-force version in the tests)."""
    k = (F.col("trajectory_id") + F.col("i")) % 3
    think = F.when(k == 0, "").when(k == 1, "<think>as before</think>").otherwise("<think>as before</think> ")
    return _messages(spark, sf).select("trajectory_id", "i", text.format_reward(F.concat(think, "content")).alias("reward"))


_VERDICTS = """SELECT trace_id, CASE trace_id % 4 WHEN 0 THEN '{"grounded": true, "reason": "seen"}' WHEN 1 THEN 'So "grounded": true, "reason": "' || coalesce(provider, 'x') || '"' WHEN 2 THEN 'It says "Grounded":false' ELSE coalesce(verifier_reason, '') END AS r FROM (SELECT DISTINCT trace_id, provider, verifier_reason FROM verified_traces WHERE trace_id IS NOT NULL)"""


@query(f"""SELECT trace_id, r LIKE '%"grounded": true%' AS grounded, coalesce(nullif(regexp_extract(r, '"reason"\\s*:\\s*"([^"]+)"', 1), ''), CASE WHEN lower(r) LIKE '%"grounded": true%' THEN 'Verified (partial JSON recovery)' WHEN lower(r) LIKE '%"grounded":false%' THEN 'Rejected (partial JSON recovery)' ELSE 'verifier output unparseable' END) AS reason FROM ({_VERDICTS})""")
def verdict_extract(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("trace_id") % 4
    r = F.when(k == 0, '{"grounded": true, "reason": "seen"}').when(k == 1, F.concat(F.lit('So "grounded": true, "reason": "'), F.coalesce("provider", F.lit("x")), F.lit('"'))).when(k == 2, 'It says "Grounded":false').otherwise(F.coalesce("verifier_reason", F.lit("")))
    grounded, reason = text.verdict(F.col("r"))
    v = read_table(spark, sf, "verified_traces").where("trace_id is not null").select("trace_id", "provider", "verifier_reason").distinct().select("trace_id", r.alias("r"))
    return v.select("trace_id", grounded.alias("grounded"), reason.alias("reason"))


@query(f"""WITH {SCORED} SELECT record_id, coalesce(array_to_string(list_transform(list_filter(gt, lambda x: x IS NOT NULL), lambda f: 'Q' || coalesce(f.quadrant::VARCHAR, '?') || 'T' || coalesce(f.tooth_position::VARCHAR, '?') || ':' || coalesce(f.diagnosis, '?')), '; '), '') AS hint FROM t""")
def hint_text(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("record_id", text.findings_hint(F.filter("gt", lambda x: x.isNotNull())).alias("hint"))


@query(f"""WITH {SCORED}, x AS (SELECT record_id, generate_subscripts(turns, 1) AS i, unnest(turns).tool_calls_this_turn AS c FROM t WHERE turns IS NOT NULL)
    SELECT record_id, i, CASE WHEN coalesce(len(c), 0) = 0 THEN 'missing or empty list' WHEN len(c) > 4 THEN 'too many calls' WHEN len(list_filter(c, lambda y: coalesce(y.tool_name, '') = '')) > 0 THEN 'call without a tool' END AS refused FROM x""")
def tool_call_guard(spark: SparkSession, sf: str) -> DataFrame:
    turns = scored(spark, sf).select("record_id", F.posexplode("turns").alias("i", "t"))
    return turns.select("record_id", (F.col("i") + 1).alias("i"), traces.guarded_calls(F.col("t.tool_calls_this_turn")).alias("refused"))


@query(f"""WITH {SCORED}, c AS (SELECT record_id, flatten(list_transform(list_filter(coalesce(turns, []), lambda x: x IS NOT NULL), lambda x: list_filter(coalesce(x.tool_calls_this_turn, []), lambda y: y IS NOT NULL))) AS c, preds FROM t),
    d AS (SELECT record_id, c, list_filter(list_transform(list_filter(c, lambda y: y.tool_name = 'locate_tooth' AND coalesce(y.tool_ok, false)), lambda y: TRY_CAST(y.tool_args['tooth'] AS INTEGER)), lambda z: z IS NOT NULL) AS l,
        coalesce(list_transform(list_filter(preds, lambda f: f.quadrant IS NOT NULL AND f.tooth_position IS NOT NULL), lambda f: f.quadrant * 10 + f.tooth_position), []) AS told FROM c)
    SELECT record_id, CASE WHEN len(c) = 0 THEN 'no tool call' WHEN len(list_distinct(list_transform(c, lambda y: coalesce(y.tool_name, '')))) < 3 THEN 'too few tools' WHEN len(list_filter(told, lambda z: NOT list_contains(l, z))) > 0 THEN 'finding not located' END AS refused FROM d""")
def finalise_gate(spark: SparkSession, sf: str) -> DataFrame:
    calls = scoring.calls(F.col("turns"))
    return scored(spark, sf).select("record_id", traces.final_gate(calls, scoring.located(calls), F.col("preds")).alias("refused"))


@query(f"""WITH {SCORED}, x AS (SELECT record_id, i, coalesce(s LIKE 'tool%failed%' OR s LIKE 'invalid%', false)::INT AS e FROM (SELECT record_id, generate_subscripts(turns, 1) AS i, unnest(turns).status AS s FROM t WHERE turns IS NOT NULL)),
    y AS (SELECT *, sum(1 - e) OVER (PARTITION BY record_id ORDER BY i) AS island FROM x), z AS (SELECT record_id, i, CAST(sum(e) OVER (PARTITION BY record_id, island ORDER BY i) AS BIGINT) AS streak FROM y)
    SELECT record_id, i, streak, CASE WHEN streak >= 3 THEN 'fatal' WHEN streak = 2 THEN 'recover' ELSE 'go on' END AS verdict FROM z""")
def parse_error_streak(spark: SparkSession, sf: str) -> DataFrame:
    t = scored(spark, sf).select("record_id", F.posexplode("turns").alias("i", "t")).select("record_id", (F.col("i") + 1).alias("i"), F.col("t.status").alias("s"))
    bad = F.col("s").like("tool%failed%") | F.col("s").like("invalid%")
    return traces.error_streak(t, "record_id", "i", bad).select("record_id", "i", "streak", "verdict")


def _span(seconds: int) -> str:
    return f"count(*) OVER (PARTITION BY provider, role ORDER BY t RANGE BETWEEN {seconds * 1_000_000} PRECEDING AND CURRENT ROW)"


@query(f"""WITH c AS (SELECT event_id, event_type AS provider, user_id % 2 AS role, epoch_us(ts) AS t FROM events WHERE ts IS NOT NULL),
    w AS (SELECT provider, CAST(t // 86400000000 AS INTEGER) AS day, t - lag(t) OVER (PARTITION BY provider ORDER BY t, event_id) AS gap, {_span(600)} AS recent, row_number() OVER (PARTITION BY provider, t // 86400000000 ORDER BY t, event_id) AS number FROM c)
    SELECT provider, day, count(*) AS calls, count(*) FILTER (WHERE gap < 30000000) AS in_cooldown, count(*) FILTER (WHERE recent > 3) AS over_rolling, count(*) FILTER (WHERE number > 50) AS over_daily, max(recent) AS most_recent FROM w GROUP BY 1, 2""")
def rate_limit_audit(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events").where("ts is not null").select("event_id", F.col("event_type").alias("provider"), (F.col("user_id") % 2).alias("role"), limits.calls_micros(F.col("ts")).alias("t"))
    return limits.audit(e, "provider", "role", "t", ["event_id"], cooldown_s=30, per_span=3, span_s=600, per_day=60, hard_cap=50)


_STATE = "CASE regexp_replace(lower(status), '[^a-z]', '', 'g') WHEN 'unverified' THEN 'unverified' WHEN 'generationfailed' THEN 'generation_failed' END"


@query(f"SELECT DISTINCT image_id FROM train_cot_traces_unverified WHERE {_STATE} = 'unverified' AND image_id IS NOT NULL AND image_id NOT IN (SELECT image_id FROM verified_traces WHERE image_id IS NOT NULL)")
def pending_traces(spark: SparkSession, sf: str) -> DataFrame:
    return traces.pending(read_table(spark, sf, "train_cot_traces_unverified"), read_table(spark, sf, "verified_traces"))


@query(f"WITH {IMAGES} SELECT id FROM i WHERE id NOT IN (SELECT image_id FROM train_cot_traces_unverified WHERE {_STATE} = 'unverified' AND image_id IS NOT NULL)")
def eligible_images(spark: SparkSession, sf: str) -> DataFrame:
    return traces.eligible(images(spark, sf).select("id"), read_table(spark, sf, "train_cot_traces_unverified"))


@query(f"""WITH s AS (SELECT image_id, max(coalesce({_STATE} = 'unverified', false)::INT) AS ok FROM train_cot_traces_unverified WHERE image_id IS NOT NULL GROUP BY image_id), v AS (SELECT DISTINCT image_id, 1 AS v FROM verified_traces WHERE image_id IS NOT NULL),
    j AS (SELECT ok, v FROM s FULL JOIN v USING (image_id))
    SELECT count(*) FILTER (WHERE ok = 1) AS generated, count(*) FILTER (WHERE coalesce(ok, 0) = 0) AS without_trace, count(*) FILTER (WHERE v = 1) AS verified, count(*) FILTER (WHERE ok = 1 AND v IS NULL) AS pending,
        round(count(*) FILTER (WHERE ok = 1 AND v = 1) / greatest(count(*) FILTER (WHERE ok = 1), 1), 6)::DOUBLE AS verified_share FROM j""")
def trace_status(spark: SparkSession, sf: str) -> DataFrame:
    return traces.status_counts(read_table(spark, sf, "train_cot_traces_unverified"), read_table(spark, sf, "verified_traces"))


@query(f"WITH {ANNOTS}, c AS (SELECT image_id, count(*) AS k FROM a WHERE image_id IS NOT NULL GROUP BY image_id) SELECT image_id, least(30, greatest(6, k + 4)) AS closed_budget, greatest(12, k + 3) AS open_budget, k * 6 AS calls, CAST(ceil(k * 6 / 20) AS BIGINT) AS days, round(4.5 + 0.3 + 1.0 + 1.2 + k * 0.6, 2)::DOUBLE AS gb FROM c")
def turn_budget(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    per = annots(spark, sf).where("image_id is not null").groupBy("image_id").agg(F.count("*").alias("k"))
    calls, days = budget.call_budget(k, 3, 20)
    return per.select("image_id", budget.turn_budget(k, 6, 30, 4).alias("closed_budget"), budget.open_turn_budget(k, 12).alias("open_budget"), calls.alias("calls"), days.alias("days"), budget.memory(k, F.lit(2048))["estimated_peak_gb"].alias("gb"))


@query("SELECT trajectory_id, CAST(sum(length(coalesce(m.content, '')) // 4) AS BIGINT) + 600 * count(*) FILTER (WHERE contains(m.content, '<Image>')) AS tokens FROM (SELECT DISTINCT trajectory_id, generate_subscripts(messages, 1) AS i, unnest(messages) AS m FROM agent_trajectory WHERE messages IS NOT NULL) WHERE m IS NOT NULL GROUP BY trajectory_id")
def context_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Estimated context per trajectory: a token for four letters, 600 for an image."""
    m = read_table(spark, sf, "agent_trajectory").select("trajectory_id", F.posexplode("messages").alias("i", "m")).where("m is not null").distinct()
    c = F.coalesce("m.content", F.lit(""))
    return m.groupBy("trajectory_id").agg(F.sum(budget.token_estimate(F.length(c), F.contains(c, F.lit("<Image>")).cast("int"))).alias("tokens"))


@query("WITH c AS (SELECT * FROM (VALUES " + ", ".join("('" + n.replace("'", "''") + f"', {k}, '{c}', '{a}')" for n, k, c, _, a, *_ in CATALOG) + ") v(name, n_images, country, annotation_type)) SELECT annotation_type, count(*) AS datasets, CAST(sum(n_images) AS BIGINT) AS images, arg_max(name, n_images) AS largest FROM c GROUP BY annotation_type")
def catalog_summary(spark: SparkSession, sf: str) -> DataFrame:
    return catalog(spark).groupBy("annotation_type").agg(F.count("*").alias("datasets"), F.sum("n_images").alias("images"), F.max_by("name", "n_images").alias("largest"))


_GB = "4.5 + 0.3 + 1.0 + 1.2 + 0.6 * g"


@query(f"""SELECT g AS group_size, k AS kl_beta, round({_GB}, 2)::DOUBLE AS gb, {_GB} <= 23.0 AS fits_24, {_GB} <= 15.0 AS fits_16, round(0.6 * g, 2)::DOUBLE AS activations,
    round(3e9::DOUBLE * 0.5 / 1073741824, 2)::DOUBLE AS base_gb, round(3e9::DOUBLE * 0.5 / 1073741824 + 3e7 * 2 / 1073741824 + 3e7 * 16 / 1073741824 + g::DOUBLE * 2048 * 4096 * 8 / 1073741824 + 2048.0::DOUBLE * 4096 * 2 / 1073741824 + 1.2, 2)::DOUBLE AS analytic_gb
    FROM (VALUES (2), (4), (8), (16), (32)) a(g), (VALUES (0.0::DOUBLE), (0.01::DOUBLE), (0.1::DOUBLE)) b(k)""")
def training_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Every group size with every penalty weight, each with both memory estimates."""
    cells = F.flatten(F.transform(F.array(*map(F.lit, (2, 4, 8, 16, 32))), lambda g: F.transform(F.array(*map(F.lit, (0.0, 0.01, 0.1))), lambda k: F.struct(g.alias("group_size"), k.alias("kl_beta")))))
    grid = spark.range(1).select(F.inline(cells))
    rule, parts = budget.memory(F.col("group_size"), F.lit(2048)), budget.analytic_memory(F.col("group_size"), F.lit(2048))
    return grid.select("group_size", "kl_beta", rule["estimated_peak_gb"].alias("gb"), rule["fits_in_24gb"].alias("fits_24"), rule["fits_in_16gb"].alias("fits_16"), rule["peak_activations_gb"].alias("activations"), parts["base_model_gb"].alias("base_gb"), parts["total_gb"].alias("analytic_gb"))


@query("SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS step FROM events WHERE ts IS NOT NULL")
def log_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Step numbers of a log's rows in the order of their times."""
    e = read_table(spark, sf, "events").where("ts is not null").withColumn("t", limits.calls_micros(F.col("ts")))
    r = running_total(e, ["event_type"], ["t", "event_id"], F.lit(1), "step", bucket=F.floor(F.col("t") / 600_000_000))
    return r.select("event_id", "event_type", (F.col("step") + 1).alias("step"))


# Replies of a server, by the number of an event.
_TOLD = ["500 Internal error", "HTTP 502 bad gateway", "Server said 503. Try later", "504", "code 500", "HTTP 5000", "HTTP 501 not implemented", "HTTP 429", "Model UNAVAILABLE", "Internal Server Error", "timeout", "overloaded", "  503 ", "505 x", "status only"]


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE event_id % 15 IN (0, 1, 2, 3, 8, 9, 12) OR (event_id % 15 = 14 AND 490 + event_id % 40 BETWEEN 500 AND 599)) AS server_errors FROM events GROUP BY event_type")
def server_error_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Errors on the server's side among the replies to each kind of event. By the published
    rule a code counts before a blank or dot, or at the start: not 'code 500', not 'timeout'."""
    k = F.col("event_id") % 15
    told = F.get(F.array(*[F.lit(t) for t in _TOLD]), k.cast("int"))
    status = F.when(k == 14, 490 + F.col("event_id") % 40)
    return read_table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(text.server_error(told, status)).alias("server_errors"))


@query("SELECT doc_id, source, trim(lower(source)) NOT IN ('', 'none') AND NOT starts_with(trim(lower(source)), 'your_') AND NOT contains(lower(source), 'placeholder') AS usable FROM documents WHERE source IS NOT NULL")
def usable_keys(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents").where("source is not null")
    return d.select("doc_id", "source", text.usable_key(F.col("source")).alias("usable"))


def _assistant(c: Column) -> Column:
    return text.reply_prose(c)


@query("SELECT DISTINCT trajectory_id, array_to_string(list_transform(list_filter(messages, lambda m: lower(trim(m.role)) = 'assistant' AND m.content IS NOT NULL), lambda m: m.content), chr(10) || chr(10)) AS said FROM agent_trajectory WHERE messages IS NOT NULL")
def assistant_text(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "agent_trajectory").where("messages is not null").select("trajectory_id", _assistant(F.col("messages")).alias("said")).distinct()


@query(f"""WITH {SCORED}, u AS (SELECT record_id, generate_subscripts(turns, 1) AS i, unnest(turns) AS t FROM t WHERE turns IS NOT NULL)
    SELECT t.record_id, coalesce(g.told, '') AS told FROM t LEFT JOIN (SELECT record_id, string_agg(coalesce(t.raw_output, ''), chr(10) ORDER BY i) AS told FROM u WHERE t IS NOT NULL GROUP BY record_id) g USING (record_id)""")
def reasoning_text(spark: SparkSession, sf: str) -> DataFrame:
    """What each record's turns put out, joined by line breaks."""
    return scored(spark, sf).select("record_id", text.reasoning(F.col("turns")).alias("told"))


_MARK = "[Earlier tool result omitted]"
_IS_IMAGE = "contains(m.content, '<Image>')"


@query(f"""WITH u AS (SELECT DISTINCT trajectory_id, generate_subscripts(messages, 1) AS i, unnest(messages) AS m FROM agent_trajectory WHERE messages IS NOT NULL AND trajectory_id IS NOT NULL),
    k AS (SELECT *, coalesce({_IS_IMAGE}, false) AND i > 1 AS im FROM u), r AS (SELECT *, sum(im::INT) OVER (PARTITION BY trajectory_id ORDER BY i DESC) AS later FROM k),
    s AS (SELECT trajectory_id, sum(length(coalesce(m.content, '')) // 4) + 600 * count(*) FILTER (WHERE {_IS_IMAGE}) AS tokens FROM u GROUP BY trajectory_id)
    SELECT trajectory_id, i, CASE WHEN im AND later > 1 AND tokens > 100 THEN '{_MARK}' ELSE m.content END AS content FROM r JOIN s USING (trajectory_id) WHERE m IS NOT NULL""")
def trimmed_context(spark: SparkSession, sf: str) -> DataFrame:
    """Messages with all but the last image given up where the estimate is over the limit;
    the first message keeps its image."""
    m = read_table(spark, sf, "agent_trajectory").where("trajectory_id is not null and messages is not null").select("trajectory_id", "messages").distinct()
    kept = budget.trimmed(F.col("messages"), limit=100, keep=1, mark=_MARK)
    return m.select("trajectory_id", F.posexplode(kept).alias("i", "m")).where("m is not null").select("trajectory_id", (F.col("i") + 1).cast("bigint").alias("i"), F.col("m.content").alias("content"))


@query(f"""WITH {IMAGES}, v AS (SELECT DISTINCT trajectory_id, image_id, generate_subscripts(messages, 1) AS i, unnest(messages).content AS c FROM agent_trajectory WHERE messages IS NOT NULL)
    SELECT trajectory_id, i, replace(c, '"<Image>"', '"file://' || coalesce(i.local_path, '') || '"') AS content FROM v LEFT JOIN i ON i.id = v.image_id WHERE c LIKE '%"<Image>"%'""")
def images_put_in(spark: SparkSession, sf: str) -> DataFrame:
    """Messages with an image's mark replaced by the file of their trajectory's image."""
    paths = images(spark, sf).select(F.col("id").alias("image_id"), "local_path")
    m = read_table(spark, sf, "agent_trajectory").select("trajectory_id", "image_id", F.posexplode("messages").alias("i", "m")).select("trajectory_id", "image_id", (F.col("i") + 1).cast("bigint").alias("i"), F.col("m.content").alias("content")).where(F.contains("content", F.lit('"<Image>"'))).distinct()
    return m.join(paths, "image_id", "left").select("trajectory_id", "i", text.with_image(F.col("content"), F.coalesce("local_path", F.lit(""))).alias("content"))


@query(f"""WITH {SCORED}, u AS (SELECT record_id, gt, generate_subscripts(c, 1) AS i, unnest(c) AS c FROM (SELECT record_id, gt, flatten(list_transform(list_filter(coalesce(turns, []), lambda x: x IS NOT NULL), lambda x: list_filter(coalesce(x.tool_calls_this_turn, []), lambda y: y IS NOT NULL))) AS c FROM t)),
    h AS (SELECT record_id, i, TRY_CAST(c.tool_args['tooth'] AS INTEGER) AS tooth, gt FROM u WHERE c.tool_name = 'locate_tooth')
    SELECT record_id, i, tooth, list_filter(gt, lambda f: f IS NOT NULL AND f.quadrant = tooth // 10 AND f.tooth_position = tooth % 10 AND f.bbox IS NOT NULL AND tooth BETWEEN 10 AND 99)[1].bbox AS hint FROM h""")
def box_hints(spark: SparkSession, sf: str) -> DataFrame:
    """For each search for a tooth the box of the first true finding there, null without one."""
    c = scored(spark, sf).select("record_id", "gt", F.posexplode(scoring.calls(F.col("turns"))).alias("i", "c")).where("c.tool_name = 'locate_tooth'")
    tooth = F.col("c.tool_args")["tooth"].try_cast("int")
    return c.select("record_id", "gt", (F.col("i") + 1).cast("bigint").alias("i"), tooth.alias("tooth")).select("record_id", "i", "tooth", scoring.box_hint(F.col("gt"), F.col("tooth")).alias("hint"))


@query(f"""WITH {IMAGES}, v AS (SELECT * FROM (SELECT trace_id, image_id, image_path, row_number() OVER (PARTITION BY trace_id ORDER BY image_id NULLS FIRST, image_path NULLS FIRST) AS rn FROM verified_traces WHERE trace_id IS NOT NULL) WHERE rn = 1)
    SELECT trace_id, coalesce(nullif(image_path, ''), i.local_path) AS path FROM v LEFT JOIN i ON i.id = v.image_id""")
def trace_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The path of each verified trace's image: its own, else that of its image's row."""
    v = read_table(spark, sf, "verified_traces").where("trace_id is not null").groupBy("trace_id").agg(F.min(F.struct("image_id", "image_path")).alias("s")).select("trace_id", "s.*")
    paths = images(spark, sf).select(F.col("id").alias("image_id"), "local_path")
    return v.join(paths, "image_id", "left").select("trace_id", F.coalesce(F.nullif("image_path", F.lit("")), "local_path").alias("path"))


@query(f"""WITH {SCORED}, p AS (SELECT record_id, image_id, generate_subscripts(preds, 1) AS i, unnest(preds) AS f FROM t WHERE preds IS NOT NULL)
    SELECT record_id, i, 'Analyze this panoramic X-ray (image_id=' || coalesce(CAST(image_id AS VARCHAR), 'unknown') || ').' AS prompt, 'Q' || coalesce(CAST(f.quadrant AS VARCHAR), '?') || 'T' || coalesce(CAST(f.tooth_position AS VARCHAR), '?') || ':' || coalesce(f.diagnosis, '?') AS target FROM p WHERE f IS NOT NULL""")
def training_examples(spark: SparkSession, sf: str) -> DataFrame:
    """One record to many examples: a row for each finding that its answer has."""
    e = traces.examples(scored(spark, sf), "record_id", "image_id", "preds", lambda f: text.findings_hint(F.array(f)))
    return e.select("record_id", (F.col("i") + 1).cast("bigint").alias("i"), "prompt", "target")


@query(f"""WITH {SCORED} SELECT count(*) AS n, count(*) FILTER (WHERE format_ok) AS good, round(count(*) FILTER (WHERE format_ok) / greatest(count(*), 1), 6)::DOUBLE AS rate FROM (SELECT * FROM t ORDER BY record_id LIMIT 10)""")
def judged_share(spark: SparkSession, sf: str) -> DataFrame:
    """The grounded share of the first ten records, as a judge handed in from outside tells
    it (here one that believes well-formed answers)."""
    def judge(batches):
        for b in batches:
            yield b.assign(grounded=b["format_ok"])[["record_id", "grounded"]]

    first = scored(spark, sf).select("record_id", "format_ok").orderBy("record_id").limit(10)
    return traces.grounding_rate(first.mapInPandas(judge, "record_id long, grounded boolean")).withColumnRenamed("grounded", "good")


@query(f"""WITH {IMAGES}, {ANNOTS} SELECT i.id, CAST(count(a.id) % 5 AS BIGINT) AS answer FROM i JOIN a ON a.image_id = i.id WHERE i.id NOT IN (SELECT image_id FROM train_cot_traces_unverified WHERE {_STATE} = 'unverified' AND image_id IS NOT NULL) GROUP BY i.id""")
def agent_batch(spark: SparkSession, sf: str) -> DataFrame:
    """A function handed in from outside, run once on every image that isn't done yet."""
    k = annots(spark, sf).where("image_id is not null").groupBy(F.col("image_id").alias("id")).agg(F.count("*").alias("k"))
    todo = traces.eligible(images(spark, sf).select("id").join(k, "id"), read_table(spark, sf, "train_cot_traces_unverified"))
    return traces.run_agent(todo, "id", lambda b: b["k"] % 5, "long")


@query("""WITH e AS (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) - 1 AS r, date_trunc('day', ts) AS d FROM events WHERE ts IS NOT NULL),
    k AS (SELECT *, r % 7 AS key FROM e) SELECT key, CAST(epoch_us(d) // 86400000000 AS INTEGER) AS day, count(*) AS calls, count(*) FILTER (WHERE n > 19) AS over_cap, count(*) FILTER (WHERE gap < 15000000) AS waited
    FROM (SELECT *, row_number() OVER (PARTITION BY key, d ORDER BY ts, event_id) AS n, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY key ORDER BY ts, event_id) AS gap FROM k) GROUP BY 1, 2""")
def key_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Calls dealt in turn to seven keys, and how many of a key's would have waited or gone
    over its daily cap (rates and caps times the margin of 0.95)."""
    e = read_table(spark, sf, "events").where("ts is not null").select("event_id", limits.calls_micros(F.col("ts")).alias("t"))
    return limits.round_robin(e, "t", ["event_id"], keys=7, per_minute=5, per_day=20, margin=0.95)
