"""Scored rows, replies and items derived from the driver's tables, as DataFrames and as the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CONDITIONS = ["clean", "blind_tags", "blind_notags", "corrupt"]
CATEGORIES = ["perception", "prediction", "planning", "behavior", ""]
METHODS = ["answer_tag", "sole_letter", "boxed", "final_line", ""]


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scored row for each event: its type is the model, its user the question."""
    e = table(spark, sf_dir, "events")
    pick = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), (i + 1).cast("int"))
    k = F.get_json_object("props", "$.k").cast("long")
    limit = F.when(F.col("event_type") == "view", 30.0).when(F.col("event_type") == "click", 50.0).otherwise(70.0)
    kind = F.col("event_type")
    return e.select(
        F.struct("ts", "event_id").alias("seq"),
        "event_id",
        F.col("user_id").cast("string").alias("question_id"),
        kind.alias("model_label"),
        pick(CONDITIONS, F.col("event_id") % 4).alias("condition"),
        pick(CATEGORIES, F.col("user_id") % 5).alias("category"),
        (F.col("value") < limit).alias("correct"),
        ((F.col("value") < limit) | (F.col("event_id") % 7 != 0)).alias("valid"),
        (2 + F.col("user_id") % 3).cast("int").alias("n_options"),
        pick(METHODS, F.col("event_id") % 5).alias("extraction_method"),
        (k + 50).alias("prompt_tokens"),
        (k + 10).alias("completion_tokens"),
        F.when((kind != "signup") & (F.col("event_id") % 3 != 0), k).alias("reasoning_tokens"),
        ((kind != "signup") & (F.col("event_id") % 3 != 0)).alias("reasoning_tokens_reported"),
        F.when(F.col("event_id") % 10 != 0, F.col("value") * 3).alias("latency_ms"),
        F.when(kind != "error", F.when(kind == "view", 1.0).otherwise(0.5)).alias("usd_per_1m_input"),
        F.when(kind != "error", F.when(kind == "view", 4.0).otherwise(2.0)).alias("usd_per_1m_output"),
        F.when(kind != "click", "2026-01-01").otherwise("").alias("price_quoted_on"),
        F.concat(F.lit("p"), (F.col("event_id") % 2).cast("string")).alias("served_by"),
        F.when(kind == "purchase", F.concat(F.lit("fp"), (F.col("event_id") % 2 * 8 + 8).cast("string"))).otherwise("fp8").alias("quantization"),
        F.concat(F.lit("mcq@v"), (F.col("event_id") % 2).cast("string")).alias("prompt_key"),
        F.when(kind != "view", "abcdef1").alias("git_sha"),
        F.when(F.col("event_id") % 4 == 3, F.when((kind == "click") & (F.col("event_id") % 8 == 7), "fog").otherwise("motion_blur")).alias("corruption"),
        F.when(F.col("event_id") % 4 == 3, 3).alias("corruption_severity"),
        F.when(F.col("event_id") % 9 == 0, "terminal_error").otherwise("success").alias("status"),
    )


SCORED = """
    scored AS (
        SELECT {'ts': ts, 'event_id': event_id} AS seq, event_id, user_id::VARCHAR AS question_id, event_type AS model_label,
               ['clean', 'blind_tags', 'blind_notags', 'corrupt'][(event_id % 4 + 1)::INT] AS condition,
               ['perception', 'prediction', 'planning', 'behavior', ''][(user_id % 5 + 1)::INT] AS category,
               value < t AS correct, value < t OR event_id % 7 <> 0 AS valid, (2 + user_id % 3)::INT AS n_options,
               ['answer_tag', 'sole_letter', 'boxed', 'final_line', ''][(event_id % 5 + 1)::INT] AS extraction_method,
               k + 50 AS prompt_tokens, k + 10 AS completion_tokens,
               CASE WHEN event_type <> 'signup' AND event_id % 3 <> 0 THEN k END AS reasoning_tokens,
               event_type <> 'signup' AND event_id % 3 <> 0 AS reasoning_tokens_reported,
               CASE WHEN event_id % 10 <> 0 THEN value * 3 END AS latency_ms,
               CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS usd_per_1m_input,
               CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN 4.0::DOUBLE ELSE 2.0::DOUBLE END AS usd_per_1m_output,
               CASE WHEN event_type <> 'click' THEN '2026-01-01' ELSE '' END AS price_quoted_on,
               'p' || (event_id % 2) AS served_by,
               CASE WHEN event_type = 'purchase' THEN 'fp' || (event_id % 2 * 8 + 8) ELSE 'fp8' END AS quantization,
               'mcq@v' || (event_id % 2) AS prompt_key,
               CASE WHEN event_type <> 'view' THEN 'abcdef1' END AS git_sha,
               CASE WHEN event_id % 4 = 3 THEN CASE WHEN event_type = 'click' AND event_id % 8 = 7 THEN 'fog' ELSE 'motion_blur' END END AS corruption,
               CASE WHEN event_id % 4 = 3 THEN 3 END AS corruption_severity,
               CASE WHEN event_id % 9 = 0 THEN 'terminal_error' ELSE 'success' END AS status
        FROM (SELECT *, (props::JSON->>'$.k')::BIGINT AS k, CASE event_type WHEN 'view' THEN 30 WHEN 'click' THEN 50 ELSE 70 END AS t FROM events)
    ),
    last_rows AS (
        SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY model_label, condition, question_id ORDER BY seq DESC) = 1
    )
"""

OPTIONS = ["Going ahead", "Turning right", "Back up", "Stopped"]


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply for each event in one of twelve shapes, with its letters and options."""
    e = table(spark, sf_dir, "events")
    letter = F.substring(F.lit("ABCD"), (F.col("user_id") % 4 + 1).cast("int"), F.lit(1))
    option = F.element_at(F.array(*[F.lit(o) for o in OPTIONS]), (F.col("user_id") % 4 + 1).cast("int"))
    m = F.col("event_id") % 12
    c = F.concat
    shapes = [c(F.lit("Answer: "), letter), c(F.lit("The final answer is "), letter, F.lit(".")), letter, c(F.lit("("), letter, F.lit(")")), c(F.lit("so \\boxed{"), letter, F.lit("}")), c(F.lit("Reasoning here.\n\n"), letter), c(F.lit("<think>maybe A or B</think>\nIt is (D) then Answer: "), letter), c(F.lit("I think it will "), F.lower(option), F.lit(" now")), F.lit("I cannot determine this."), F.lit("It is either A or D, hard to say."), c(F.lit("perhaps * "), letter, F.lit(", yes")), F.lit("  ")]
    out = F.when(m == 0, shapes[0])
    for i, s in enumerate(shapes[1:], 1):
        out = out.when(m == i, s)
    return e.select("event_id", out.alias("reply"), F.array(*[F.lit(x) for x in "ABCD"]).alias("letters"), F.array(*[F.lit(o) for o in OPTIONS]).alias("option_texts"))


REPLIES = r"""
    replies AS (
        SELECT event_id, CASE event_id % 12
            WHEN 0 THEN 'Answer: ' || l WHEN 1 THEN 'The final answer is ' || l || '.' WHEN 2 THEN l WHEN 3 THEN '(' || l || ')'
            WHEN 4 THEN 'so \boxed{' || l || '}' WHEN 5 THEN 'Reasoning here.' || chr(10) || chr(10) || l
            WHEN 6 THEN '<think>maybe A or B</think>' || chr(10) || 'It is (D) then Answer: ' || l
            WHEN 7 THEN 'I think it will ' || lower(o) || ' now' WHEN 8 THEN 'I cannot determine this.'
            WHEN 9 THEN 'It is either A or D, hard to say.' WHEN 10 THEN 'perhaps * ' || l || ', yes' ELSE '  ' END AS reply
        FROM (SELECT event_id, substr('ABCD', (user_id % 4 + 1)::INT, 1) AS l, ['Going ahead', 'Turning right', 'Back up', 'Stopped'][(user_id % 4 + 1)::INT] AS o FROM events)
    )
"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as question items: the language is the category, the source names the template, the quality is the answer."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select(
        F.concat(F.lit("s"), F.col("doc_id") % 50).alias("scene_id"),
        F.concat(F.lit("f"), F.col("doc_id")).alias("frame_id"),
        (F.col("doc_id") % 7).cast("int").alias("idx"),
        F.col("lang").alias("category"),
        F.concat(F.lit("What of  <c1,CAM_FRONT,1.5,"), F.col("doc_id"), F.lit("> in "), F.concat(F.lit("group"), F.ascii(F.substring("source", -1, 1)) % 3), F.lit(" ?")).alias("question"),
        F.when((F.col("quality") == 1) & (F.col("doc_id") % 2 == 0), " Good. ").otherwise("Not  good").alias("answer"),
    )


ITEMS = """
    items AS (
        SELECT 's' || (doc_id % 50) AS scene_id, 'f' || doc_id AS frame_id, (doc_id % 7)::INT AS idx, lang AS category, doc_id,
               'What of <OBJ> in group' || (ascii(right(source, 1)) % 3) || ' ?' AS template,
               'What of <c1,CAM_FRONT,1.5,' || doc_id || '> in group' || (ascii(right(source, 1)) % 3) || ' ?' AS stem,
               CASE WHEN quality = 1 AND doc_id % 2 = 0 THEN 'Good' ELSE 'Not good' END AS gold_text
        FROM documents JOIN labels USING (doc_id)
    ),
    spec AS (
        SELECT substr(sha256('["' || category || '","' || template || '"]'), 1, 12) AS template_id, category, template,
               list(gold_text ORDER BY c DESC, gold_text) AS options, list(c ORDER BY c DESC, gold_text) AS counts,
               sum(c)::BIGINT AS n_total, count(*) AS n_options, max(c) / sum(c) AS majority_share, min(c) * count(*) AS capacity
        FROM (SELECT category, template, gold_text, count(*) AS c FROM items GROUP BY ALL)
        GROUP BY category, template
        HAVING count(*) BETWEEN 2 AND 6 AND sum(c) >= 10 AND max(c) / sum(c) <= 0.75
    ),
    sizes AS (SELECT template_id, n_options, options, gold_text, count(*) AS class_n FROM items JOIN spec USING (category, template) GROUP BY ALL),
    taken AS (SELECT *, min(class_n) OVER (PARTITION BY template_id) AS take FROM sizes),
    sample AS (
        SELECT *, row_number() OVER (PARTITION BY template_id, gold_text ORDER BY CASE WHEN take < class_n THEN
                   sha256('[0,"' || template_id || '","' || gold_text || '",["' || scene_id || '","' || frame_id || '",' || idx || ']]') END, scene_id, frame_id, idx) - 1 AS rank
        FROM items JOIN spec USING (category, template) JOIN (SELECT template_id, gold_text, class_n, take FROM taken) USING (template_id, gold_text)
        QUALIFY rank < take
    ),
    questions AS (
        SELECT substr(sha256('["drivelm_conv","' || scene_id || '","' || frame_id || '","' || category || '","' || idx || '"]'), 1, 16) AS question_id,
               scene_id, frame_id, category, stem, template_id, gold_text, rank,
               [chr((65 + i)::INT) FOR i IN range(len(options))] AS letters,
               [o FOR o IN options IF o <> gold_text][1:(rank % len(options))::INT] || [gold_text] || [o FOR o IN options IF o <> gold_text][(rank % len(options) + 1)::INT:] AS option_texts,
               chr((65 + rank % len(options))::INT) AS gold_letter
        FROM sample
    )
"""
