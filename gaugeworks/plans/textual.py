"""Queries over texts, replies, templates, cohorts and calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions import hashing, text, usage
from gaugeworks.operators import cohort, collect, stats
from gaugeworks.plans.analysis import register
from gaugeworks.plans.testdata import ITEMS, REPLIES, items, replies, scored, table


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question with object tags for each document."""
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    first = F.concat(F.lit("<c"), n % 5, F.lit(",CAM_"), F.element_at(F.array(*[F.lit(x) for x in ("FRONT", "BACK", "FRONT_LEFT")]), (n % 3 + 1).cast("int")), F.lit(","), n, F.lit(".5,"), n % 90, F.lit(".25>"))
    second = F.when(n % 2 == 0, F.lit("<c9, CAM_BACK_RIGHT, near the  kerb>")).otherwise("")
    return d.select("doc_id", F.when(n % 7 == 0, F.concat(F.lit("What now?  "), "source")).otherwise(F.concat(F.lit("  What is "), first, F.lit("  next to "), second, F.lit(" in\n"), "source", F.lit(" ? "))).alias("stem"))


TAGGED = """tagged AS (
    SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'What now?  ' || source ELSE '  What is <c' || doc_id % 5 || ',CAM_' || ['FRONT', 'BACK', 'FRONT_LEFT'][(doc_id % 3 + 1)::INT] || ',' || doc_id || '.5,' || doc_id % 90 || '.25>'
           || '  next to ' || CASE WHEN doc_id % 2 = 0 THEN '<c9, CAM_BACK_RIGHT, near the  kerb>' ELSE '' END || ' in' || chr(10) || source || ' ? ' END AS stem
    FROM documents)"""


@register("strip_tags", "SELECT doc_id, trim(regexp_replace(regexp_replace(stem, '<[a-zA-Z][0-9]+,\\s*CAM_[A-Z_]+,\\s*[-0-9.]+,\\s*[-0-9.]+>', 'the referenced object', 'g'), '\\s{2,}', ' ', 'g')) AS stem FROM tagged", TAGGED)
def strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged(spark, sf_dir).select("doc_id", text.strip_tags(F.col("stem")).alias("stem"))


@register("stem_for_condition", "SELECT doc_id, condition, CASE condition WHEN 'blind_notags' THEN trim(regexp_replace(regexp_replace(stem, '<[a-zA-Z][0-9]+,\\s*CAM_[A-Z_]+,\\s*[-0-9.]+,\\s*[-0-9.]+>', 'the referenced object', 'g'), '\\s{2,}', ' ', 'g')) ELSE stem END AS stem FROM tagged, (SELECT unnest(['clean', 'blind_notags']) AS condition)", TAGGED)
def stem_for_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = tagged(spark, sf_dir).withColumn("condition", F.explode(F.array(F.lit("clean"), F.lit("blind_notags"))))
    return both.select("doc_id", "condition", text.stem_for(F.col("condition"), F.col("stem")).alias("stem"))


@register("template_normalize", "SELECT template, count(*) AS n FROM (SELECT trim(regexp_replace(regexp_replace(stem, '<[a-zA-Z][0-9]+,\\s*CAM_[A-Z_]+,[^>]*>', '<OBJ>', 'g'), '\\s+', ' ', 'g')) AS template FROM tagged) GROUP BY template", TAGGED)
def template_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged(spark, sf_dir).groupBy(text.template(F.col("stem")).alias("template")).agg(F.count(F.lit(1)).alias("n"))


@register("cameras", "SELECT doc_id, CASE WHEN len(c) = 0 THEN 'CAM_FRONT' ELSE array_to_string(c, ',') END AS cameras FROM (SELECT doc_id, regexp_extract_all(stem, '<[a-zA-Z][0-9]+,\\s*(CAM_[A-Z_]+),', 1) AS c FROM tagged)", TAGGED)
def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged(spark, sf_dir).select("doc_id", F.array_join(text.cameras(F.col("stem")), ",").alias("cameras"))


@register("options_block", "SELECT event_id, 'A. Going ahead' || chr(10) || 'B. Turning right' || chr(10) || 'C. Back up' || chr(10) || 'D. Stopped' AS block FROM events", "")
def options_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies(spark, sf_dir).select("event_id", text.options_block(F.col("letters"), F.col("option_texts")).alias("block"))


LENGTHS = "CASE WHEN n < 50 THEN '<50' WHEN n < 100 THEN '<100' WHEN n < 200 THEN '<200' WHEN n < 400 THEN '<400' WHEN n < 800 THEN '<800' ELSE '>=800' END"


@register("length_buckets", f"SELECT lang, {LENGTHS} AS bucket, count(*) AS n FROM (SELECT lang, length(text) AS n FROM documents) GROUP BY 1, 2", "")
def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang", text.length_bucket(F.char_length("text")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _probe_sql() -> str:
    q = {k: p.replace("(?i)", "").replace("(?s)", "") for k, p in text.PATTERNS.items()}
    part = lambda k, p, c, o: f"SELECT lang, '{k}' AS pattern, count(*) FILTER (regexp_matches({c}, '{p}', '{o}')) AS n FROM q GROUP BY lang"
    rows = [part(k, p, "q", "i" if "(?i)" in text.PATTERNS[k] else "s" if "(?s)" in text.PATTERNS[k] else "c") for k, p in q.items()]
    rows += [part(k, p, "a", "c") for k, p in text.GOLD_PATTERNS.items()]
    body = " UNION ALL ".join(rows)
    return f"WITH q AS (SELECT lang, left(text, 200) || CASE doc_id % 4 WHEN 0 THEN ' Please select the correct answer from the following options: A. Go B. Stop' WHEN 1 THEN ' (A) Go' WHEN 2 THEN chr(10) || '  A. x' ELSE ' option A: y' END AS q, CASE doc_id % 3 WHEN 0 THEN ' B. ' WHEN 1 THEN 'C) go' ELSE source END AS a FROM documents) {body}"


def _probed(spark: SparkSession, sf_dir: str, lead: Column) -> DataFrame:
    """Counts over made-up questions: ``lead`` and a tail with options."""
    from gaugeworks.sources.annotations import probe_counts

    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id") % 4
    tail = F.when(n == 0, " Please select the correct answer from the following options: A. Go B. Stop").when(n == 1, " (A) Go").when(n == 2, "\n  A. x").otherwise(" option A: y")
    a = F.when(F.col("doc_id") % 3 == 0, " B. ").when(F.col("doc_id") % 3 == 1, "C) go").otherwise(F.col("source"))
    return probe_counts(d.select(F.col("lang").alias("category"), F.concat(lead, tail).alias("question"), a.alias("answer"))).withColumnRenamed("category", "lang")


@register("probe_patterns", _probe_sql(), "")
def probe_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As its SQL: over the first 200 characters only. ``probe_patterns_whole`` reads all."""
    return _probed(spark, sf_dir, F.substring("text", 1, 200))


@register("probe_patterns_whole")
def probe_patterns_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probed(spark, sf_dir, F.col("text"))


def _mcq(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i = F.col("event_id") % 5
    lead = " Please select the correct answer from the following options: "
    q = F.when(i == 0, F.concat(F.lit("What next, A. or not?"), F.lit(lead), F.lit("A. Back up. B. Drive on; C. Brake, D. "), "event_type", F.lit("."))).when(i == 1, F.concat(F.lit("Is it (A) near or (B) far "), "event_type")).when(i == 2, F.concat(F.lit("Choose."), F.lit(lead.upper()), F.lit("A) Go B) Stop D) "), "event_type")).when(i == 3, F.concat(F.lit("What of "), "event_type", F.lit("?"))).otherwise(F.concat(F.lit("Pick: A. B. "), "event_type"))
    gold = F.when(i == 0, "Brake").when(i == 1, "(B) far").when(i == 2, "B.").otherwise("A")
    return e.select("event_id", "event_type", q.alias("q"), gold.alias("a"))


@register(
    "split_options",
    """SELECT event_id,
        CASE event_id % 5 WHEN 0 THEN 'What next, A. or not?' WHEN 1 THEN 'Is it (' WHEN 2 THEN 'Choose.' WHEN 3 THEN 'What of ' || event_type || '?' ELSE 'Pick: A. B. ' || event_type END AS stem,
        CASE event_id % 5 WHEN 0 THEN 'A,B,C,D' WHEN 1 THEN 'A,B' WHEN 2 THEN 'A,B' ELSE '' END AS letters,
        CASE event_id % 5 WHEN 0 THEN 'Back up|Drive on|Brake|' || event_type WHEN 1 THEN 'near or (|far ' || event_type WHEN 2 THEN 'Go|Stop D) ' || event_type ELSE '' END AS options,
        CASE event_id % 5 WHEN 0 THEN 'C' WHEN 2 THEN 'B' END AS gold_letter FROM events""",
    "",
)
def split_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _mcq(spark, sf_dir).withColumn("s", text.split_question(F.col("q")))
    return s.select("event_id", F.col("s.stem").alias("stem"), F.array_join("s.letters", ",").alias("letters"), F.array_join("s.option_texts", "|").alias("options"), text.gold_letter(F.col("a"), F.col("s.letters"), F.col("s.option_texts")).alias("gold_letter"))


@register(
    "answer_parse",
    """SELECT event_id, CASE m WHEN 8 THEN NULL WHEN 9 THEN NULL WHEN 11 THEN NULL ELSE l END AS letter,
        CASE WHEN m IN (0, 1, 6) THEN 'answer_tag' WHEN m IN (2, 3) THEN 'sole_letter' WHEN m = 4 THEN 'boxed' WHEN m = 5 THEN 'final_line' WHEN m = 7 THEN 'option_text' WHEN m = 9 THEN 'ambiguous' WHEN m = 10 THEN 'first_letter' ELSE 'unparseable' END AS method,
        CASE m WHEN 9 THEN 'A,D' ELSE '' END AS candidates FROM (SELECT event_id, event_id % 12 AS m, substr('ABCD', (user_id % 4 + 1)::INT, 1) AS l FROM events)""",
    "",
)
def answer_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = replies(spark, sf_dir).withColumn("x", text.extracted(F.col("reply"), F.col("letters"), F.col("option_texts")))
    return r.select("event_id", F.col("x.letter").alias("letter"), F.col("x.method").alias("method"), F.array_join("x.candidates", ",").alias("candidates"))


@register("thinking_chars", "SELECT event_id, coalesce(length(regexp_extract(reply, '<think>.*?</think>', 0, 's')), 0)::INT AS n, regexp_replace(reply, '<think>.*?</think>', ' ', 'gs') AS rest FROM replies", REPLIES)
def thinking_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies(spark, sf_dir).select("event_id", text.thinking_chars(F.col("reply")).alias("n"), text.without_thinking(F.col("reply")).alias("rest"))


@register("question_id_hash", "SELECT doc_id, substr(sha256('[\"' || source || '\",\"' || lang || '\",\"' || doc_id || '\"]'), 1, 16) AS question_id FROM documents", "")
def question_id_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", hashing.question_id(F.col("source"), F.col("lang"), F.col("doc_id")).alias("question_id"))


@register(
    "usage_extract",
    """SELECT event_id, 50 + k AS prompt_tokens, k AS completion_tokens, 50 + 2 * k AS total_tokens, CASE event_id % 3 WHEN 0 THEN k + 1 WHEN 1 THEN k + 2 END AS reasoning_tokens, CASE WHEN event_id % 2 = 0 THEN 0 END AS cached_prompt_tokens, event_id % 3 < 2 AS reasoning_tokens_reported
       FROM (SELECT event_id, (props::JSON->>'$.k')::BIGINT AS k FROM events)""",
    "",
)
def usage_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    n = F.col("event_id")
    detail = F.when(n % 3 == 0, F.concat(F.lit(',"completion_tokens_details":{"reasoning_tokens":'), F.col("k") + 1, F.lit("}"))).when(n % 3 == 1, F.concat(F.lit(',"reasoning_tokens":'), F.col("k") + 2)).otherwise("")
    cached = F.when(n % 2 == 0, ',"prompt_tokens_details":{"cached_tokens":0}').otherwise("")
    payload = F.concat(F.lit('{"usage":{"prompt_tokens":'), F.col("k") + 50, F.lit(',"completion_tokens":'), "k", F.lit(',"total_tokens":'), F.col("k") * 2 + 50, detail, cached, F.lit("}}"))
    return e.select("event_id", usage.extracted(payload).alias("u")).select("event_id", "u.*")


@register(
    "terminal_reason",
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'context_overflow' WHEN 1 THEN 'content_refusal' WHEN 2 THEN 'auth' WHEN 3 THEN 'unknown_model' WHEN 4 THEN 'http_418' ELSE 'context_overflow' END AS reason FROM events""",
    "",
)
def terminal_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 6
    status = F.when(n == 2, 403).when(n == 3, 404).when(n == 4, 418).otherwise(400)
    body = F.when(n == 0, "Context LENGTH exceeded").when(n == 1, "content policy").when(n == 5, "context window; content filter")
    return table(spark, sf_dir, "events").select("event_id", text.terminal_reason(status, body).alias("reason"))


def _specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.discover(items(spark, sf_dir), min_total=10)


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.balanced(items(spark, sf_dir), _specs(spark, sf_dir))


@register("template_discovery", "SELECT template_id, category, template, array_to_string(options, '|') AS options, array_to_string(counts, '|') AS counts, n_total, n_options, round(majority_share, 9) AS majority_share, capacity FROM spec", ITEMS)
def template_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _specs(spark, sf_dir)
    return s.withColumns({"options": F.array_join("options", "|"), "counts": F.array_join(F.transform("counts", lambda c: c.cast("string")), "|")})


@register("balanced_sample", "SELECT question_id, scene_id, frame_id, category, template_id, gold_text, stem, rank FROM questions", ITEMS)
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("question_id", "scene_id", "frame_id", "category", "template_id", "gold_text", "stem", F.col("rank").cast("long").alias("rank"))


@register("counterbalance", "SELECT question_id, array_to_string(letters, '') AS letters, array_to_string(option_texts, '|') AS options, gold_letter FROM questions", ITEMS)
def counterbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("question_id", F.array_join("letters", "").alias("letters"), F.array_join("option_texts", "|").alias("options"), "gold_letter")


@register(
    "joint_balance_audit",
    """SELECT CASE grouping_id(category, template_id, gold_text, gold_letter) WHEN 7 THEN 'category' WHEN 11 THEN 'template' WHEN 14 THEN 'letter' WHEN 9 THEN 'class' ELSE 'joint' END AS check_group, category, template_id, gold_text, gold_letter, count(*) AS n
       FROM questions GROUP BY GROUPING SETS ((category), (template_id), (gold_letter), (template_id, gold_text), (template_id, gold_text, gold_letter))""",
    ITEMS,
)
def joint_balance_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.audit(_questions(spark, sf_dir))


@register(
    "unbalanced_cells",
    """SELECT check_group, within, min(n) AS least, max(n) AS most FROM (
        SELECT 'template' AS check_group, '' AS within, count(*) AS n FROM questions GROUP BY template_id UNION ALL SELECT 'letter', '', count(*) FROM questions GROUP BY gold_letter
        UNION ALL SELECT 'class', template_id, count(*) FROM questions GROUP BY template_id, gold_text UNION ALL SELECT 'joint', template_id, count(*) FROM questions GROUP BY template_id, gold_text, gold_letter
       ) GROUP BY check_group, within HAVING min(n) <> max(n)""",
    ITEMS,
)
def unbalanced_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.unbalanced(cohort.audit(_questions(spark, sf_dir)))


@register("repeat_subset", "SELECT template_id, gold_text, gold_letter, question_id, count(*) OVER c < 3 AS short FROM questions WINDOW c AS (PARTITION BY template_id, gold_text, gold_letter) QUALIFY row_number() OVER (PARTITION BY template_id, gold_text, gold_letter ORDER BY question_id) <= 3", ITEMS)
def repeat_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.repeat_subset(_questions(spark, sf_dir), 3)


@register(
    "cache_plan_antijoin",
    "SELECT o_orderkey AS call_id, o_custkey AS customer FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "",
)
def cache_plan_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as planned calls and returned lines as the cache's records: what is still to call."""
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    planned = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return planned.join(done, "o_orderkey", "left_anti").select(F.col("o_orderkey").alias("call_id"), F.col("o_custkey").alias("customer"))


@register("budget_replay", "SELECT event_id, spent_before FROM (SELECT event_id, coalesce(sum(c) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent_before FROM (SELECT event_id, (props::JSON->>'$.k')::BIGINT AS c FROM events WHERE event_type = 'view')) WHERE spent_before < 5000", "")
def budget_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").where("event_type = 'view'").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("usd"))
    return collect.within_budget(calls, 5000, "event_id", "usd").select("event_id", F.col("spent_before").cast("long").alias("spent_before"))


@register(
    "determinism_compare",
    """, x AS (SELECT user_id AS question_id, event_type, reply FROM replies JOIN events USING (event_id) WHERE event_id % 9 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1)
       SELECT count(*) AS n_compared, count(*) FILTER (a.reply = b.reply) AS n_identical, round(count(*) FILTER (a.reply = b.reply) / count(*), 9) AS identical_frac FROM x a JOIN x b ON a.question_id = b.question_id AND a.event_type = 'view' AND b.event_type = 'click'""",
    REPLIES,
)
def determinism_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reply with its call's status; the operator leaves out failed ones."""
    calls = scored(spark, sf_dir).select("event_id", F.col("model_label").alias("event_type"), F.col("question_id").cast("long").alias("question_id"), "status")
    rows = replies(spark, sf_dir).join(calls, "event_id").select("question_id", "event_type", F.col("reply").alias("response_text"), "status", F.col("event_id").alias("seq"))
    return collect.determinism(rows.where("event_type = 'view'"), rows.where("event_type = 'click'"))


@register(
    "pilot_summary",
    """SELECT count(*) AS n_calls, count(*) FILTER (ok) AS n_success, round(count(*) FILTER (ok AND reasoning_tokens_reported) / count(*) FILTER (ok), 9) AS reasoning_reported_frac, round(count(*) FILTER (ok AND NOT valid) / count(*) FILTER (ok), 9) AS invalid_rate,
        round(avg(prompt_tokens) FILTER (ok), 9) AS mean_prompt_tokens, round(avg(completion_tokens) FILTER (ok), 9) AS mean_completion_tokens, round(quantile_cont(latency_ms, 0.5) FILTER (ok), 9) AS median_latency_ms, round(quantile_cont(latency_ms, 0.95) FILTER (ok), 9) AS p95_latency_ms,
        string_agg(DISTINCT served_by, ',' ORDER BY served_by) FILTER (ok) AS served_models FROM (SELECT *, status = 'success' AS ok FROM scored)""",
)
def pilot_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collect.pilot(scored(spark, sf_dir).withColumn("served_model", F.col("served_by")))


@register("sizing", "SELECT n, h, ceil(0.25 * (1.96 / h) * (1.96 / h))::INT AS wanted, floor(floor(5 / 0.000322::DOUBLE) / n)::INT AS paid FROM (SELECT unnest([4, 8, 20]) AS n), (SELECT unnest([0.04, 0.05])::DOUBLE AS h)", "")
def sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(n, h, s["questions_for_target_precision"], s["questions_at_budget_one_seed"]) for n in (4, 8, 20) for h in (0.04, 0.05) for s in [collect.sizing(0.000322, 5, n, 1, h)]]
    return spark.createDataFrame(rows, "n int, h double, wanted int, paid int")


@register(
    "public_projection",
    """SELECT event_id, substr(sha256(question_id), 1, 16) AS question_id, model_label, condition, correct, valid, prompt_tokens, completion_tokens, round(prompt_tokens * usd_per_1m_input / 1000000, 9) AS input_cost_usd, round(completion_tokens * usd_per_1m_output / 1000000, 9) AS output_cost_usd,
        round(prompt_tokens * usd_per_1m_input / 1000000 + completion_tokens * usd_per_1m_output / 1000000, 9) AS total_cost_usd, array_to_string(list_concat(CASE WHEN extraction_method = '' THEN ['extraction_method'] ELSE [] END, CASE WHEN git_sha IS NULL THEN ['git_sha'] ELSE [] END), ',') AS errors FROM scored""",
)
def public_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeworks.operators import export

    rows = scored(spark, sf_dir)
    full = rows.withColumn("question_id", F.substring(hashing.sha256(F.col("question_id")), 1, 16)).withColumns({"gold_letter": F.lit("A"), "predicted_letter": F.lit("B"), "model_string": F.lit("org/model"), "cohort_id": F.lit("a" * 64), "prompt_hash": F.lit("b" * 64)})
    out = export.public(full, keep=["event_id"])
    return out.select("event_id", "question_id", "model_label", "condition", "correct", "valid", "prompt_tokens", "completion_tokens", "input_cost_usd", "output_cost_usd", "total_cost_usd", F.array_join("errors", ",").alias("errors"))


@register("filter_null_safe", "SELECT model_label, count(*) AS n FROM scored WHERE reasoning_tokens IS NOT DISTINCT FROM NULL AND condition = 'clean' GROUP BY model_label")
def filter_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.where_equal(scored(spark, sf_dir), reasoning_tokens=None, condition="clean").groupBy("model_label").agg(F.count(F.lit(1)).alias("n"))


@register("corruptions")
def corruptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every corruption at every severity of small images made from the embeddings: four pixels of three channels to a row, as many rows as hold all values, zeros after the last."""
    from gaugeworks.operators import corrupt

    v = table(spark, sf_dir, "embeddings").where(F.size("embedding") > 0)
    width, channels = 4, 3
    height = F.ceil(F.size("embedding") / (width * channels)).cast("int")
    values = F.transform("embedding", lambda x: F.pmod((F.abs(x) * 1000).cast("int"), F.lit(256)))
    pixels = F.concat(values, F.array_repeat(F.lit(0), height * width * channels - F.size("embedding")))
    images = v.select(F.col("vec_id").alias("image_id"), height.alias("height"), F.lit(width).alias("width"), F.lit(channels).alias("channels"), pixels.alias("pixels"))
    return corrupt.apply(images)
