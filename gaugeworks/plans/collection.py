"""Queries over the parts of a collection run: keys, manifests, counters, pacing, samples, and joins to scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions import hashing, text, usage
from gaugeworks.operators import cohort, collect, images, stats
from gaugeworks.plans.analysis import register
from gaugeworks.plans.testdata import ITEMS, items, scored, table
from gaugeworks.plans.textual import _questions, _specs
from gaugeworks.sources import annotations, records


@register("response_parse", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'thought ' || event_id ELSE 'said ' || event_type END AS text, CASE WHEN event_id % 3 < 2 THEN 'thought ' || event_id ELSE '' END AS reasoning FROM events""", "")
def response_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of chat payloads: content, or reasoning where there is none, under either of its names."""
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    thought = F.concat(F.lit("thought "), n)
    message = F.struct(F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("said "), "event_type")).alias("content"), F.when(n % 3 == 0, thought).alias("reasoning_content"), F.when(n % 3 == 1, thought).alias("reasoning"))
    payload = F.to_json(F.struct(F.array(F.struct(message.alias("message"))).alias("choices")))
    return e.select("event_id", usage.reply(payload).alias("r")).select("event_id", "r.*")


GOLD = """CASE WHEN event_id % 4 = 0 THEN ' B. ' WHEN event_id % 4 = 1 THEN 'c) Turning  right' WHEN event_id % 4 = 2 THEN 'STOPPED!' ELSE 'A: anything' END"""


@register("gold_letter", f"SELECT event_id, {GOLD} AS answer, CASE event_id % 4 WHEN 0 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'A' END AS letter FROM events", "")
def gold_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters that gold answers mean: a letter alone, one before a text, the only option of the text, or none."""
    a = lambda *xs: F.array(*[F.lit(x) for x in xs])
    rows = table(spark, sf_dir, "events").withColumn("answer", F.expr(GOLD))
    return rows.select("event_id", "answer", text.gold_letter(F.col("answer"), a("A", "B", "C"), a("Going on", "Turning right", "Stopped")).alias("letter"))


@register("cache_index", "SELECT user_id || ':' || event_type AS cache_key, arg_max(CASE WHEN event_id % 9 = 0 THEN 'terminal_error' ELSE 'success' END, event_id) AS status FROM events GROUP BY 1", "")
def cache_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last status of each key of a cache, in order of arrival."""
    rows = scored(spark, sf_dir)
    return records.index(rows.select(F.concat_ws(":", "question_id", "model_label").alias("cache_key"), "status", "seq"))


FIELDS = ["model", "served_by", "quantization", "decode", "seed", "images", "corruption", "corruption_severity", "question_id", "condition", "prompt_key", "prompt_hash", "prompt_user"]
VALUES = {"model": "'\"m\"'", "served_by": "'\"p\"'", "quantization": "'\"fp8\"'", "decode": "'\"{}\"'", "seed": "'0'", "images": "'\"\"'", "corruption": "'\"fog\"'", "corruption_severity": "'3'", "question_id": "'\"' || o_orderkey || '\"'", "condition": "'\"clean\"'", "prompt_key": "'\"mcq@v1\"'", "prompt_hash": "'\"' || sha256('mcq' || chr(0) || 'v1' || chr(0) || 's' || chr(0) || 'u') || '\"'", "prompt_user": "'\"' || o_orderpriority || '\"'"}
KEY_SQL = " || ',' || ".join(f"'\"{n}\":' || {VALUES[n]}" for n in sorted(FIELDS))


@register("cache_key", f"SELECT o_orderkey, sha256('{{' || {KEY_SQL} || '}}') AS cache_key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')", "")
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of planned calls that the cache has no record of, by everything that may change a reply."""
    own = hashing.prompt_hash(F.lit("mcq"), F.lit("v1"), F.lit("s"), F.lit("u"))
    planned = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("question_id"), F.lit("clean").alias("condition"), F.lit("mcq@v1").alias("prompt_key"), own.alias("prompt_hash"), F.col("o_orderpriority").alias("prompt_user"))
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    settings = {"model": "m", "decode": "{}", "served_by": "p", "quantization": "fp8", "corruption": "fog", "severity": 3}
    none = spark.createDataFrame([], "cache_key string")
    keys = collect.plan(planned, none, **settings)
    cache = keys.join(done, "o_orderkey", "left_semi").select("cache_key")
    return collect.plan(planned, cache, **settings).select("o_orderkey", "cache_key")


ENTRY = """'{"camera":"' || c || '","sha256":"' || sha256(c || o_orderkey) || '"}'"""


@register(
    "manifest_hash",
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE sha256('{{"corruption":"fog","images":[' || s || '],"jpeg_quality":90,"max_edge":0,"severity":3}}') END AS images_hash
        FROM (SELECT o_orderkey, string_agg({ENTRY}, ',' ORDER BY c) AS s FROM orders, (SELECT unnest(['CAM_BACK', 'CAM_FRONT']) AS c) GROUP BY o_orderkey)""",
    "",
)
def manifest_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hashes of the images of calls, which are part of their keys; empty without images."""
    refs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("question_id"), F.explode(F.array(F.lit("CAM_FRONT"), F.lit("CAM_BACK"))).alias("camera"))
    refs = refs.withColumns({"path": F.col("camera"), "source_sha256": hashing.sha256(F.concat("camera", F.col("question_id").cast("string")))})
    found = images.manifests(refs).withColumn("images", F.when(F.col("question_id") % 5 == 0, F.slice("images", 1, 0)).otherwise(F.col("images")))
    return found.select(F.col("question_id").alias("o_orderkey"), hashing.manifest_hash(F.col("images"), F.lit("fog"), F.lit(3)).alias("images_hash"))


@register("collection_counters", """SELECT count(*)::BIGINT + 7 AS planned, count(*)::BIGINT AS stored, count(*) FILTER (status = 'success')::BIGINT AS success, count(*) FILTER (status = 'terminal_error')::BIGINT AS terminal_errors, 7::BIGINT AS retryable,
    sum(prompt_tokens) FILTER (status = 'success')::BIGINT AS prompt_tokens, sum(completion_tokens) FILTER (status = 'success')::BIGINT AS completion_tokens,
    round((sum(prompt_tokens) FILTER (status = 'success') * 1.0::DOUBLE + sum(completion_tokens) FILTER (status = 'success') * 4.0::DOUBLE) / 1000000, 8) AS measured_usd FROM scored""")
def collection_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    return collect.counters(rows, rows.count() + 7, 1.0, 4.0)


@register("pacing_audit", """SELECT event_type, count(*) AS n_calls, count(*) FILTER (gap < 60) AS n_too_soon, min(gap)::BIGINT AS least_gap FROM (SELECT event_type, s - lag(s) OVER (PARTITION BY event_type ORDER BY s) AS gap FROM (SELECT event_type, floor(epoch(ts))::BIGINT AS s FROM events)) GROUP BY event_type""", "")
def pacing_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each kind that began within a minute of the one before."""
    calls = table(spark, sf_dir, "events").select("event_type", F.unix_timestamp("ts").alias("s"))
    return collect.pacing(calls, "s", 1.0, "event_type")


@register("iso_stamp", "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || 'Z' AS ts_iso FROM events", "")
def iso_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", collect.stamp(F.unix_timestamp("ts")).alias("ts_iso"))


@register("scored_union", "SELECT model_label, condition, count(*) AS n, max(part) AS last_part FROM (SELECT *, 0 AS part FROM scored WHERE condition = 'clean' UNION ALL SELECT *, 1 FROM scored WHERE model_label <> 'view') GROUP BY 1, 2")
def scored_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two scored tables put after each other, duplicates kept."""
    rows = scored(spark, sf_dir)
    both = rows.where("condition = 'clean'").withColumn("part", F.lit(0)).unionByName(rows.where("model_label <> 'view'").withColumn("part", F.lit(1)))
    return both.groupBy("model_label", "condition").agg(F.count(F.lit(1)).alias("n"), F.max("part").alias("last_part"))


@register("pool_summary", "SELECT category, count(*) AS n, round(avg(1 / len(letters)), 9) AS expected_chance FROM questions GROUP BY category", ITEMS)
def pool_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.summary(_questions(spark, sf_dir), "category")


@register("conversion_stats", "SELECT template_id, gold_text, gold_letter, count(*) AS n FROM questions GROUP BY GROUPING SETS ((template_id), (template_id, gold_text), (template_id, gold_letter))", ITEMS)
def conversion_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.conversion_stats(_questions(spark, sf_dir))


@register("template_allow_list", "SELECT template_id, count(*) AS n FROM questions WHERE template_id IN (SELECT min(template_id) FROM spec) GROUP BY 1", ITEMS)
def template_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of allowed templates only."""
    specs = _specs(spark, sf_dir)
    allowed = specs.agg(F.min("template_id").alias("template_id"))
    return cohort.balanced(items(spark, sf_dir), specs.join(allowed, "template_id", "left_semi")).groupBy("template_id").agg(F.count(F.lit(1)).alias("n"))


@register("cohort_select", "SELECT question_id, row_number() OVER (ORDER BY question_id) - 1 AS pos, gold_letter FROM questions", ITEMS)
def cohort_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions of a frozen cohort, in its order; a cohort's ids are few."""
    q = _questions(spark, sf_dir)
    ids = [r[0] for r in q.select("question_id").orderBy("question_id").collect()]
    own = {"schema": 1, "benchmark": "b", "adapter": "a", "source": {"sha256": "s"}, "selection": {}, "question_ids": ids}
    return cohort.select(q, own | {"cohort_id": cohort.identity("b", "a", "s", {}, ids)}).select("question_id", "pos", "gold_letter")


@register("seeded_sample", "SELECT question_id FROM questions ORDER BY md5('5:' || question_id), question_id LIMIT 20", ITEMS)
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of questions, the same for a seed wherever it is drawn; a limit is the feature here."""
    return collect.sampled(_questions(spark, sf_dir), 20, 5).select("question_id")


@register("pilot_head", "SELECT question_id FROM questions ORDER BY question_id LIMIT 20", ITEMS)
def pilot_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions of a pilot: the first ones by id; a limit is the feature here."""
    return collect.limited(_questions(spark, sf_dir), 20).select("question_id")


@register("bounded_examples", "SELECT i.category, substr(replace(i.stem, 'What of ', 'What of  '), 1, 420) AS question, CASE WHEN i.gold_text = 'Good' THEN ' Good. ' ELSE 'Not  good' END AS answer FROM items i QUALIFY row_number() OVER (PARTITION BY i.category ORDER BY i.scene_id, i.frame_id, i.idx) <= 3", ITEMS)
def bounded_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three items of each category, cut to a length, as a report shows them; a limit is the feature here."""
    return annotations.examples(items(spark, sf_dir))


@register("score_join", "SELECT s.event_id, s.question_id, c.c_mktsegment AS option_text, CASE WHEN s.event_id % 2 = 0 THEN 'A' ELSE 'Q' END AS gold FROM scored s LEFT JOIN customer c ON s.question_id = c.c_custkey::VARCHAR")
def score_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with what the question adds: a record's own gold letter counts before the question's."""
    q = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("question_id"), F.array("c_mktsegment").alias("option_texts"), F.lit("Q").alias("q_gold"))
    own = scored(spark, sf_dir).select("event_id", "question_id", F.when(F.col("event_id") % 2 == 0, "A").otherwise("").alias("gold_letter"))
    return own.join(q, "question_id", "left").select("event_id", "question_id", F.get("option_texts", F.lit(0)).alias("option_text"), F.coalesce(F.nullif("gold_letter", F.lit("")), F.lit("Q")).alias("gold"))


LAST = "last AS (SELECT model_label, condition, question_id, arg_max(correct, seq)::INT AS c FROM scored GROUP BY 1, 2, 3)"
DRAWN = """m AS (SELECT *, row_number() OVER (PARTITION BY model_label ORDER BY question_id) - 1 AS i, count(*) OVER (PARTITION BY model_label) AS n FROM d),
    r AS (SELECT model_label, b, ('0x' || substr(md5('0|' || b || '|' || i), 1, 8))::BIGINT % n AS i FROM m, range(200) t(b)),
    e AS (SELECT r.model_label, r.b, sum(m.v) / count(*) AS mean FROM r JOIN m ON r.model_label = m.model_label AND r.i = m.i GROUP BY 1, 2)
    SELECT model_label, round(quantile_cont(mean, 0.025), 9) AS ci_low, round(quantile_cont(mean, 0.975), 9) AS ci_high FROM e GROUP BY 1"""


def paired(a: str, b: str, also: str = "") -> str:
    more = f"JOIN last z ON x.model_label = z.model_label AND x.question_id = z.question_id AND z.condition = '{also}'" if also else ""
    return f", {LAST}, d AS (SELECT x.model_label, x.question_id, (x.c - y.c)::DOUBLE AS v FROM last x JOIN last y ON x.model_label = y.model_label AND x.question_id = y.question_id AND y.condition = '{b}' {more} WHERE x.condition = '{a}'), {DRAWN}"


@register("grounding_ci", paired("clean", "blind_notags", "blind_tags"))
def grounding_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval of the grounding gap, one draw for both arms, from 200 resamples that SQL can draw too."""
    return stats.paired_hash_interval(scored(spark, sf_dir), "clean", "blind_notags", ["blind_tags"])


@register("robustness_ci", paired("clean", "corrupt"))
def robustness_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval of the robustness delta, one draw for both arms, from 200 resamples that SQL can draw too."""
    return stats.paired_hash_interval(scored(spark, sf_dir), "clean", "corrupt")


@register("accuracy_ci", f", d AS (SELECT model_label, question_id || ':' || event_id AS question_id, correct::INT::DOUBLE AS v FROM scored WHERE condition = 'clean'), {DRAWN}")
def accuracy_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval of the accuracy over all rows of a condition, from 200 resamples that SQL can draw too."""
    rows = scored(spark, sf_dir).where("condition = 'clean'").select("model_label", F.concat_ws(":", "question_id", "event_id").alias("at"), stats.flag("correct").cast("double").alias("v"))
    return stats.hash_bootstrap(rows, "model_label", "v", "at")
