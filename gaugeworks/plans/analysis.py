"""Queries over scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators import stats
from gaugeworks.plans.registry import QUERIES, SQL
from gaugeworks.plans.testdata import SCORED, scored, table


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to nine places, so that sums in another order compare equal."""
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def register(name: str, sql: str | None = None, base: str = SCORED):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            SQL[name] = f"WITH {base} {sql}" if base else sql
        return f

    return add


KEYS = ["model_label", "condition"]
ACC = "count(*) AS n, count(*) FILTER (valid) AS n_valid, round(count(*) FILTER (correct) / count(*), 9) AS accuracy, round(1 - count(*) FILTER (valid) / count(*), 9) AS invalid_rate"
CHANCE = "chance AS (SELECT model_label, condition, avg(1.0::DOUBLE / n_options) AS chance FROM last_rows GROUP BY ALL)"


@register("accuracy_by_model_condition", f", {CHANCE} SELECT model_label, condition, {ACC}, round(any_value(chance), 9) AS chance FROM scored JOIN chance USING (model_label, condition) GROUP BY ALL")
def accuracy_by_model_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    return stats.accuracy(rows, *KEYS).join(stats.chance(rows, *KEYS), KEYS)


@register("accuracy_by_category", f"SELECT model_label, condition, CASE category WHEN '' THEN 'unknown' ELSE category END AS category, {ACC} FROM scored GROUP BY 1, 2, 3")
def accuracy_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.by_category(scored(spark, sf_dir))


@register("extraction_breakdown", "SELECT model_label, condition, method, n, round(n / sum(n) OVER (PARTITION BY model_label, condition), 4) AS fraction FROM (SELECT model_label, condition, CASE extraction_method WHEN '' THEN 'unknown' ELSE extraction_method END AS method, count(*) AS n FROM scored GROUP BY ALL)")
def extraction_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.extraction(scored(spark, sf_dir), *KEYS)


@register("chance_accuracy", f", {CHANCE} SELECT model_label, condition, round(chance, 9) AS chance FROM chance")
def chance_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.chance(scored(spark, sf_dir), *KEYS)


TOKENS = """, v AS (SELECT *, bool_or(reasoning_tokens_reported) OVER (PARTITION BY model_label, condition) AS rep FROM scored)
    SELECT model_label, condition, CASE WHEN any_value(rep) THEN 'reasoning_tokens' ELSE 'completion_tokens' END AS token_metric, NOT any_value(rep) AS is_proxy,
           round(count(*) FILTER (reasoning_tokens_reported) / count(*), 9) AS reasoning_reported_frac,
           round(avg(CASE WHEN rep THEN reasoning_tokens ELSE completion_tokens END), 9) AS mean_tokens,
           round(quantile_cont(CASE WHEN rep THEN reasoning_tokens ELSE completion_tokens END::DOUBLE, 0.5), 9) AS median_tokens,
           round(quantile_cont(CASE WHEN rep THEN reasoning_tokens ELSE completion_tokens END::DOUBLE, 0.95), 9) AS p95_tokens,
           round(quantile_cont(latency_ms, 0.5), 9) AS median_latency_ms, round(quantile_cont(latency_ms, 0.95), 9) AS p95_latency_ms
    FROM v GROUP BY ALL"""


@register("token_profile", TOKENS)
def token_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.tokens(scored(spark, sf_dir), *KEYS)


COST = """cost AS (
    SELECT model_label, condition, i AS usd_per_1m_input, o AS usd_per_1m_output, input_tokens, output_tokens, n_correct,
           input_tokens / 1e6 * i + output_tokens / 1e6 * o AS total, n, price_quoted_on, served_by, price_quoted_on = '' AS price_unstamped
    FROM (
        SELECT model_label, condition, arg_min(usd_per_1m_input, seq) FILTER (usd_per_1m_input IS NOT NULL) AS i, arg_min(usd_per_1m_output, seq) FILTER (usd_per_1m_input IS NOT NULL) AS o,
               sum(prompt_tokens)::BIGINT AS input_tokens, sum(completion_tokens)::BIGINT AS output_tokens, count(*) AS n, count(*) FILTER (correct) AS n_correct,
               coalesce(string_agg(DISTINCT nullif(price_quoted_on, ''), ',' ORDER BY nullif(price_quoted_on, '')), '') AS price_quoted_on, string_agg(DISTINCT served_by, ',' ORDER BY served_by) AS served_by
        FROM scored GROUP BY ALL
    ) WHERE i IS NOT NULL)"""


@register("cost_profile", f", {COST} SELECT model_label, condition, usd_per_1m_input, usd_per_1m_output, input_tokens, output_tokens, n_correct, round(total, 9) AS total_usd, round(total / n, 9) AS usd_per_call, round(total / nullif(n_correct, 0), 9) AS usd_per_correct, price_quoted_on, served_by, price_unstamped FROM cost")
def cost_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cost(scored(spark, sf_dir), *KEYS)


@register(
    "cost_by_nation",
    """SELECT n_name AS nation, count(*) AS n, round(sum(l_quantity), 2) AS tokens, round(sum(l_quantity) / 1e6 * 1.5, 9) AS total_usd
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
    "",
)
def cost_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line quantities as tokens, by the customer's nation. Nations are a fixed few; the rest joins as its size asks."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    # summed by order first: one row for each goes on to the other joins
    per_order = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("k"), F.sum("l_quantity").alias("q"))
    rows = per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("nation").agg(F.sum("k").alias("n"), F.round(F.sum("q"), 2).alias("tokens"), (F.sum("q") / 1e6 * 1.5).alias("total_usd"))


@register("dedupe_last_wins", "SELECT model_label, condition, question_id, event_id, correct, valid FROM last_rows")
def dedupe_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.last_answers(scored(spark, sf_dir).select(*KEYS, "question_id", "seq", "event_id", "correct", "valid")).drop("seq")


PAIRS = """counts AS (
        SELECT a.condition, a.model_label AS model_a, b.model_label AS model_b, count(*) AS n_shared, count(*) FILTER (a.correct AND NOT b.correct) AS b,
               count(*) FILTER (NOT a.correct AND b.correct) AS c, count(*) FILTER (a.correct) AS na, count(*) FILTER (b.correct) AS nb
        FROM last_rows a JOIN last_rows b ON a.condition = b.condition AND a.question_id = b.question_id AND a.model_label < b.model_label GROUP BY ALL
    ), pairs AS (
        SELECT *, model_a || ' vs ' || model_b AS pair, na / n_shared AS accuracy_a, nb / n_shared AS accuracy_b, (na - nb) / n_shared AS delta,
               CASE WHEN b + c = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2 * list_sum([exp(lgamma(b + c + 1.0) - lgamma(i + 1.0) - lgamma(b + c - i + 1.0) - (b + c) * ln(2.0::DOUBLE)) FOR i IN range(least(b, c) + 1)])) END AS p_raw
        FROM counts
    )"""


@register("paired_counts", f", {PAIRS} SELECT condition, pair, n_shared, b, c, round(delta, 9) AS delta FROM pairs")
def paired_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.pairs(scored(spark, sf_dir)).select("condition", "pair", "n_shared", "b", "c", "delta")


@register("pairwise_mcnemar", f", {PAIRS} SELECT condition, model_a, model_b, pair, n_shared, b, c, round(accuracy_a, 9) AS accuracy_a, round(accuracy_b, 9) AS accuracy_b, round(delta, 9) AS delta, round(p_raw, 9) AS p_raw FROM pairs")
def pairwise_mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.pairs(scored(spark, sf_dir))


HOLM = """, h AS (
        SELECT *, model_a = 'click' AND model_b = 'view' AS is_primary FROM pairs
    ), r AS (
        SELECT *, least(1.0::DOUBLE, p_raw * (count(*) OVER (PARTITION BY condition) - row_number() OVER (PARTITION BY condition ORDER BY p_raw, pair) + 1)) AS scaled FROM h WHERE NOT is_primary
    ), j AS (
        SELECT condition, pair, p_raw, is_primary, max(scaled) OVER (PARTITION BY condition ORDER BY p_raw, pair ROWS UNBOUNDED PRECEDING) AS p_adjusted FROM r
        UNION ALL SELECT condition, pair, p_raw, is_primary, p_raw FROM h WHERE is_primary
    ) SELECT condition, pair, is_primary, round(p_raw, 9) AS p_raw, round(p_adjusted, 9) AS p_adjusted, p_adjusted < 0.05 AS significant FROM j"""


@register("holm_adjust", f", {PAIRS} {HOLM}")
def holm_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.comparisons(scored(spark, sf_dir), primary=("view", "click")).select("condition", "pair", "is_primary", "p_raw", "p_adjusted", "significant")


@register(
    "grounding_decomposition",
    """, w AS (
        SELECT model_label, question_id, max(correct::INT) FILTER (condition = 'clean') AS x, max(correct::INT) FILTER (condition = 'blind_tags') AS y, max(correct::INT) FILTER (condition = 'blind_notags') AS z
        FROM last_rows GROUP BY ALL HAVING x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL
    ) SELECT model_label, count(*) AS n_shared, round(avg(x), 9) AS accuracy_clean, round(avg(y), 9) AS accuracy_blind_tags, round(avg(z), 9) AS accuracy_blind_notags,
             round((sum(x) - sum(z)) / count(*), 9) AS grounding_gap, round((sum(y) - sum(z)) / count(*), 9) AS tag_effect, round((sum(x) - sum(y)) / count(*), 9) AS image_effect
      FROM w GROUP BY ALL""",
)
def grounding_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.grounding(scored(spark, sf_dir))


COMMON = """common AS (
        SELECT l.condition, l.model_label, count(*) AS n_shared, count(*) FILTER (correct) / count(*) AS accuracy
        FROM last_rows l
        JOIN (SELECT condition, question_id, count(*) AS k FROM last_rows GROUP BY ALL) q USING (condition, question_id)
        JOIN (SELECT condition, count(DISTINCT model_label) AS models FROM last_rows GROUP BY ALL) m USING (condition)
        WHERE k = models GROUP BY ALL
    )"""


@register("all_model_intersection", f", {COMMON} SELECT condition, model_label, n_shared, round(accuracy, 9) AS accuracy FROM common")
def all_model_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.common_accuracy(scored(spark, sf_dir))


ROBUST = """rob AS (
        SELECT model_label, count(*) AS n_shared, sum(x) AS nx, sum(y) AS ny, count(*) FILTER (x = 1 AND y = 0) AS b, count(*) FILTER (x = 0 AND y = 1) AS c
        FROM (SELECT model_label, question_id, max(correct::INT) FILTER (condition = 'clean') AS x, max(correct::INT) FILTER (condition = 'corrupt') AS y FROM last_rows GROUP BY ALL HAVING x IS NOT NULL AND y IS NOT NULL)
        GROUP BY ALL
    ), own AS (
        SELECT s.* FROM scored s JOIN (SELECT model_label, question_id FROM last_rows WHERE condition IN ('clean', 'corrupt') GROUP BY ALL HAVING count(*) = 2) q USING (model_label, question_id) WHERE condition IN ('clean', 'corrupt')
    ), inv AS (
        SELECT model_label, 1 - count(*) FILTER (condition = 'clean' AND valid) / count(*) FILTER (condition = 'clean') AS ib, 1 - count(*) FILTER (condition = 'corrupt' AND valid) / count(*) FILTER (condition = 'corrupt') AS id FROM own GROUP BY ALL
    ), luck AS (
        SELECT model_label, avg(1.0::DOUBLE / n_options) AS chance FROM (SELECT DISTINCT model_label, question_id, n_options FROM own WHERE condition = 'clean') GROUP BY ALL
    ), pool AS (
        SELECT model_label, string_agg(DISTINCT corruption, '+' ORDER BY corruption) AS corruption, max(corruption_severity) AS corruption_severity, count(DISTINCT corruption) > 1 OR count(DISTINCT corruption_severity) > 1 AS pooled FROM scored WHERE condition = 'corrupt' GROUP BY ALL
    ), robust AS (
        SELECT model_label, corruption, corruption_severity, pooled, n_shared, nx / n_shared AS ab, ny / n_shared AS ad, (nx - ny) / n_shared AS delta, chance, ib, id,
               CASE WHEN b + c = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2 * list_sum([exp(lgamma(b + c + 1.0) - lgamma(i + 1.0) - lgamma(b + c - i + 1.0) - (b + c) * ln(2.0::DOUBLE)) FOR i IN range(least(b, c) + 1)])) END AS p_value,
               CASE WHEN nx / n_shared > chance THEN (ny / n_shared - chance) / (nx / n_shared - chance) END AS kept
        FROM rob JOIN inv USING (model_label) JOIN luck USING (model_label) JOIN pool USING (model_label)
    )"""


@register(
    "robustness",
    f""", {ROBUST} SELECT model_label, corruption, corruption_severity, pooled, n_shared, round(ab, 9) AS accuracy_baseline, round(ad, 9) AS accuracy_degraded, round(delta, 9) AS delta, round(p_value, 9) AS p_value,
        round(chance, 9) AS chance, round(kept, 9) AS above_chance_retention, round(ib, 9) AS invalid_rate_baseline, round(id, 9) AS invalid_rate_degraded, round(id - ib, 9) AS invalid_rate_delta FROM robust""",
)
def robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.robustness(scored(spark, sf_dir))


BOOT = """draws AS (
        SELECT model_label, b, sum(v) / count(*) AS m FROM (
            SELECT d.model_label, d.b, r.v FROM (SELECT model_label, n, b, i, ('0x' || substr(md5('0|' || b || '|' || i), 1, 8))::BIGINT % n AS j FROM numbered, (SELECT unnest(range(200)) AS b)) d
            JOIN numbered r ON r.model_label = d.model_label AND r.i = d.j)
        GROUP BY ALL
    ), ci AS (SELECT model_label, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM draws GROUP BY ALL)"""
NUMBERED = "numbered AS (SELECT model_label, correct::INT::DOUBLE AS v, row_number() OVER (PARTITION BY model_label ORDER BY question_id) - 1 AS i, count(*) OVER (PARTITION BY model_label) AS n FROM last_rows WHERE condition = 'clean')"


@register("hash_bootstrap_ci", f", {NUMBERED}, {BOOT} SELECT model_label, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high FROM ci")
def hash_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.flags(scored(spark, sf_dir)).where("condition = 'clean'")
    return stats.hash_bootstrap(rows, "model_label", "correct", "question_id")


@register(
    "retention",
    f""", {ROBUST}, {NUMBERED}, {BOOT} SELECT model_label, round(ab, 9) AS accuracy_baseline, round(chance, 9) AS chance, round(CASE WHEN ab > chance AND ci_low > chance THEN kept END, 9) AS above_chance_retention,
        CASE WHEN NOT ab > chance THEN 'baseline at or below chance' WHEN ci_low <= chance THEN 'baseline not distinguishable from chance' ELSE '' END AS retention_note FROM robust JOIN ci USING (model_label)""",
)
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    flags = stats.flags(rows).where("condition = 'clean'").withColumn("correct", F.col("correct").cast("double"))
    found = stats.with_retention(stats.robustness(rows), stats.bootstrap(flags, ["model_label"], ["correct"], "question_id"))
    return found.select("model_label", "accuracy_baseline", "chance", "above_chance_retention", "retention_note")


RANK = "ranked AS (SELECT a.model_label, a.accuracy AS x, b.accuracy AS y FROM common a JOIN common b ON a.model_label = b.model_label AND a.condition = 'clean' AND b.condition = 'corrupt')"


@register("model_ranking", f", {COMMON}, {RANK} SELECT model_label, round(x, 9) AS accuracy_baseline, round(y, 9) AS accuracy_degraded, row_number() OVER (ORDER BY x DESC, model_label)::INT AS rank_baseline, row_number() OVER (ORDER BY y DESC, model_label)::INT AS rank_degraded FROM ranked")
def model_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.ranking(scored(spark, sf_dir))


@register("kendall_tau_b", f", {COMMON}, {RANK} SELECT round(sum(sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(sum(abs(sign(a.x - b.x))) * sum(abs(sign(a.y - b.y)))), 9) AS kendall_tau_b FROM ranked a JOIN ranked b ON a.model_label < b.model_label")
def kendall_tau_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.tau_b(stats.ranking(scored(spark, sf_dir)), "model_label", "accuracy_baseline", "accuracy_degraded")


@register(
    "ranking_inversions",
    f""", {COMMON}, {RANK}, {PAIRS} SELECT a.model_label || ' vs ' || b.model_label AS pair, CASE WHEN a.x > b.x THEN a.model_label ELSE b.model_label END AS baseline_leader, CASE WHEN a.y > b.y THEN a.model_label ELSE b.model_label END AS degraded_leader,
        round(a.x - b.x, 9) AS baseline_delta, round(a.y - b.y, 9) AS degraded_delta, round(p.p_raw, 9) AS p_baseline, round(q.p_raw, 9) AS p_degraded, p.p_raw < 0.05 AND q.p_raw < 0.05 AS supported
        FROM ranked a JOIN ranked b ON a.model_label < b.model_label AND sign(a.x - b.x) * sign(a.y - b.y) < 0
        LEFT JOIN pairs p ON p.condition = 'clean' AND p.model_a = a.model_label AND p.model_b = b.model_label LEFT JOIN pairs q ON q.condition = 'corrupt' AND q.model_a = a.model_label AND q.model_b = b.model_label""",
)
def ranking_inversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.inversions(scored(spark, sf_dir))


POINTS = f"""{COST}, {CHANCE}, prof AS (
        SELECT model_label, condition, count(*) AS n, count(*) FILTER (correct) / count(*) AS accuracy, bool_or(reasoning_tokens_reported) AS rep, count(*) FILTER (reasoning_tokens_reported) / count(*) AS frac,
               avg(reasoning_tokens) AS mr, avg(completion_tokens) AS mc, quantile_cont(reasoning_tokens::DOUBLE, 0.5) AS dr, quantile_cont(completion_tokens::DOUBLE, 0.5) AS dc
        FROM scored GROUP BY ALL
    ), points AS (
        SELECT model_label, condition, n, accuracy, chance, bool_and(rep) OVER w AS all_rep, bool_and(rep) OVER w = bool_or(rep) OVER w AS uniform, frac,
               CASE WHEN bool_and(rep) OVER w THEN mr ELSE mc END AS mean_tokens, CASE WHEN bool_and(rep) OVER w THEN dr ELSE dc END AS median_tokens, cost.total / nullif(cost.n_correct, 0) AS usd_per_correct
        FROM prof JOIN chance USING (model_label, condition) LEFT JOIN (SELECT model_label, condition, total, n_correct FROM cost) cost USING (model_label, condition) WINDOW w AS (PARTITION BY condition)
    ), front AS (
        SELECT * FROM points p WHERE NOT EXISTS (SELECT 1 FROM points o WHERE o.condition = p.condition AND o.model_label <> p.model_label AND o.mean_tokens <= p.mean_tokens AND o.accuracy >= p.accuracy AND (o.mean_tokens < p.mean_tokens OR o.accuracy > p.accuracy))
    )"""


@register(
    "efficiency_points",
    f""", {POINTS} SELECT p.condition, p.model_label, p.n, round(p.accuracy, 9) AS accuracy, round(p.chance, 9) AS chance, CASE WHEN p.all_rep THEN 'reasoning_tokens' ELSE 'completion_tokens' END AS token_metric, p.uniform,
        round(p.frac, 9) AS reasoning_reported_frac, round(p.mean_tokens, 9) AS mean_tokens, round(p.median_tokens, 9) AS median_tokens, round(p.usd_per_correct, 9) AS usd_per_correct, f.model_label IS NOT NULL AS on_frontier
        FROM points p LEFT JOIN front f ON f.condition = p.condition AND f.model_label = p.model_label""",
)
def efficiency_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.efficiency(scored(spark, sf_dir))


@register("pareto_frontier", f", {POINTS} SELECT condition, model_label, round(mean_tokens, 9) AS mean_tokens, round(accuracy, 9) AS accuracy FROM front")
def pareto_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.efficiency(scored(spark, sf_dir)).where("on_frontier").select("condition", "model_label", "mean_tokens", "accuracy")


PROV = """prov AS (
        SELECT model_label, field, count(DISTINCT nullif(value, '')) AS n_values, coalesce(string_agg(DISTINCT nullif(value, ''), '|' ORDER BY nullif(value, '')), '') AS field_values, count(DISTINCT nullif(value, '')) > 1 AND field <> 'prompt_key' AS inconsistent
        FROM (SELECT model_label, served_by, quantization, prompt_key, git_sha FROM scored) UNPIVOT INCLUDE NULLS (value FOR field IN (served_by, quantization, prompt_key, git_sha)) GROUP BY model_label, field
    )"""


@register("provenance_inconsistent", f", {PROV} SELECT * FROM prov")
def provenance_inconsistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.provenance(scored(spark, sf_dir))


@register(
    "report_warnings",
    f""", {POINTS}, {PROV}, {PAIRS}, {ROBUST} SELECT model_label AS subject, 'several values of ' || field AS rule FROM prov WHERE inconsistent
        UNION ALL SELECT model_label, 'no git_sha' FROM prov WHERE field = 'git_sha' AND n_values = 0
        UNION ALL SELECT model_label || '|' || condition, 'completion tokens as a proxy' FROM prof WHERE NOT rep
        UNION ALL SELECT model_label || '|' || condition, 'price without a date' FROM cost WHERE price_unstamped
        UNION ALL SELECT model_label || '|' || condition, 'invalid rate over 10 %' FROM scored GROUP BY model_label, condition HAVING 1 - count(*) FILTER (valid) / count(*) > 0.10
        UNION ALL SELECT DISTINCT condition, 'token metric not uniform' FROM points WHERE NOT uniform
        UNION ALL SELECT model_label, 'pooled degradations' FROM robust WHERE pooled
        UNION ALL SELECT condition, 'no primary comparison' FROM pairs GROUP BY condition HAVING count(*) > 1""",
)
def report_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.warnings(scored(spark, sf_dir))


@register("pcg64_bootstrap_ci")
def pcg64_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.flags(scored(spark, sf_dir)).withColumn("correct", F.col("correct").cast("double"))
    return stats.bootstrap(rows, KEYS, ["correct"], "question_id")


@register("grounding_interval")
def grounding_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.grounding_interval(scored(spark, sf_dir))


@register("robustness_interval")
def robustness_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.robustness_interval(scored(spark, sf_dir))
