"""Hand-computed values over small scored rows."""

import math

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import stats

SCHEMA = "seq long, question_id string, model_label string, condition string, correct boolean, valid boolean, category string, n_options int, prompt_tokens long, completion_tokens long, reasoning_tokens long, reasoning_tokens_reported boolean, latency_ms double, corruption string, corruption_severity int, usd_per_1m_input double, usd_per_1m_output double, price_quoted_on string, served_by string, git_sha string, prompt_key string"


def rows(flags, model="m", condition="clean", n_options=4, valid=True, tokens=100, reasoning=True, offset=0, seq=0, **extra):
    base = {"category": "perception", "prompt_tokens": 50, "latency_ms": 500.0}
    return [
        base | {"seq": seq + i, "question_id": f"q{i + offset}", "model_label": model, "condition": condition, "correct": f, "valid": valid, "n_options": n_options, "completion_tokens": tokens, "reasoning_tokens": tokens - 10 if reasoning else None, "reasoning_tokens_reported": reasoning} | extra
        for i, f in enumerate(flags)
    ]


def flags(k, n):
    return [True] * k + [False] * (n - k)


@pytest.fixture
def frame(spark):
    def make(*parts):
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for p in parts for r in p], SCHEMA)

    return make


def p_of(spark, b, c):
    return spark.createDataFrame([(b, c)], "b long, c long").select(stats.mcnemar(F.col("b"), F.col("c")).alias("p")).first()["p"]


def test_mcnemar(spark):
    # fixed values: 7/32 by hand, and a published one
    assert p_of(spark, 1, 5) == pytest.approx(7 / 32)
    assert p_of(spark, 95, 87) == pytest.approx(0.6039706597292289, abs=1e-12)
    assert p_of(spark, 0, 0) == 1.0
    assert p_of(spark, 515, 515) == pytest.approx(1.0)
    assert 0 < p_of(spark, 30, 1100) < 1e-270


def test_holm(spark):
    raw = {"a": 0.2, "b": 0.002, "d": 0.011, "e": 0.9, "f": 0.012}
    df = spark.createDataFrame([("c", k, p) for k, p in raw.items()], "condition string, pair string, p_raw double")
    got = {r["pair"]: r["p_adjusted"] for r in stats.holm(df, ["condition"]).collect()}
    # the k-th least of five times 6 - k, and no less than the one before
    assert got == pytest.approx({"b": 0.01, "d": 0.044, "f": 0.044, "a": 0.4, "e": 0.9})


def test_primary_pair_is_not_corrected(frame):
    df = frame(rows(flags(9, 10), "a"), rows(flags(1, 10), "b"), rows(flags(5, 10), "c"))
    got = {r["pair"]: r for r in stats.comparisons(df, ("b", "a")).collect()}
    assert got["a vs b"]["p_adjusted"] == got["a vs b"]["p_raw"]
    assert got["a vs c"]["p_adjusted"] >= got["a vs c"]["p_raw"]


def test_accuracy_counts_all_rows_and_pairs_the_last(frame):
    df = frame(rows([False, True], "a"), rows([True], "a", seq=10), rows([True, True], "b"))
    assert stats.accuracy(df.where("model_label = 'a'"), "model_label").first()["n"] == 3
    pair = stats.pairs(df).first()
    assert (pair["n_shared"], pair["accuracy_a"], pair["b"], pair["c"]) == (2, 1.0, 0, 0)


def test_invalid_answers_are_wrong(frame):
    got = stats.accuracy(frame(rows([True], valid=True), rows([None], valid=None, offset=1)), "model_label").first()
    assert (got["n"], got["n_valid"], got["accuracy"], got["invalid_rate"]) == (2, 1, 0.5, 0.5)


def test_chance_takes_each_question_once(frame):
    df = frame(rows([True, False], n_options=2), rows([True], n_options=4, seq=10))
    assert stats.chance(df, "model_label").first()["chance"] == pytest.approx((1 / 4 + 1 / 2) / 2)


def test_retention(frame):
    df = frame(rows(flags(90, 100)), rows(flags(50, 100), condition="corrupt", corruption="fog", corruption_severity=3))
    got = stats.robustness(df).first()
    assert got["above_chance_retention"] == pytest.approx(0.25 / 0.65)
    assert got["delta"] == pytest.approx(0.4)
    assert not got["pooled"]
    low = stats.robustness(frame(rows(flags(20, 100)), rows(flags(50, 100), condition="corrupt"))).first()
    assert low["above_chance_retention"] is None


def test_pooling(frame):
    df = frame(rows(flags(9, 10)), rows(flags(2, 5), condition="corrupt", corruption="fog", corruption_severity=3), rows(flags(2, 5), condition="corrupt", corruption="motion_blur", corruption_severity=3, offset=5))
    assert stats.robustness(df).first()["pooled"]


def test_tau(spark):
    points = spark.createDataFrame([("a", 1.0, 1.0), ("b", 1.0, 2.0), ("c", 2.0, 3.0)], "m string, x double, y double")
    assert stats.tau_b(points, "m", "x", "y").first()[0] == pytest.approx(2 / math.sqrt(6))
    assert stats.tau_b(points.limit(1), "m", "x", "y").first()[0] is None


def test_pareto(spark):
    nan = float("nan")
    # every point against every other, by the rule: none is as good at less cost, or better at no more
    points = [(f"p{i}", float(i * 7 % 5), (i * 11 % 6) / 6) for i in range(20)] + [("unknown", None, 0.9), ("nan", nan, 1.0)]
    known = [p for p in points if p[1] is not None and p[1] == p[1]]
    best = {l for l, c, b in known if not any((d <= c and e >= b) and (d < c or e > b) for _, d, e in known)}
    df = spark.createDataFrame(points, "l string, c double, b double")
    assert {r["l"] for r in stats.pareto(df, "l", "c", "b").collect()} == best


def test_token_axis_falls_back_for_all(frame):
    df = frame(rows([True], "a", tokens=100), rows([True], "b", tokens=200, reasoning=False))
    got = {r["model_label"]: r for r in stats.efficiency(df).collect()}
    assert got["a"]["token_metric"] == got["b"]["token_metric"] == "completion_tokens"
    assert got["a"]["mean_tokens"] == 100 and not got["a"]["uniform"]


def test_prices_come_from_the_first_priced_row(frame):
    df = frame(rows([True]), rows([True], offset=1, seq=5, usd_per_1m_input=1.0, usd_per_1m_output=4.0), rows([False], offset=2, seq=9, usd_per_1m_input=9.0, usd_per_1m_output=9.0))
    got = stats.cost(df, "model_label").first()
    assert got["total_usd"] == pytest.approx(150 / 1e6 + 300 / 1e6 * 4)
    assert got["price_unstamped"] and got["n_correct"] == 2


def test_grounding(frame):
    df = frame(rows(flags(8, 10)), rows(flags(5, 10), condition="blind_tags"), rows(flags(4, 10), condition="blind_notags"), rows([True], condition="clean", offset=50))
    got = stats.grounding(df).first()
    assert got["n_shared"] == 10
    assert (got["grounding_gap"], got["tag_effect"], got["image_effect"]) == pytest.approx((0.4, 0.1, 0.3))


@pytest.mark.parametrize(("k", "n", "low", "high"), [(301, 558, 0.49821, 0.58065), (326, 600, 0.50333, 0.58333), (143, 238, 0.53782, 0.66387)])
def test_bootstrap(spark, k, n, low, high):
    df = spark.range(n).selectExpr("'g' as g", "id", f"cast(id < {k} as double) as v")
    got = stats.bootstrap(df, ["g"], ["v"], "id").first()
    assert (got["ci_low"], got["ci_high"]) == pytest.approx((low, high), abs=1e-5)


def test_bootstrap_in_chunks_is_the_same(spark):
    df = spark.range(50).selectExpr("'g' as g", "id", "cast(id % 3 = 0 as double) as v")
    whole = stats.bootstrap(df, ["g"], ["v"], "id", n_boot=500).first()
    assert stats.bootstrap(df, ["g"], ["v"], "id", n_boot=500, chunk=77).first() == whole


def test_provenance(frame):
    df = frame(rows([True], git_sha="abc", prompt_key="x"), rows([True], git_sha="abd", prompt_key="y", offset=1))
    got = {r["field"]: r["inconsistent"] for r in stats.provenance(df).collect()}
    assert got["git_sha"] and not got["prompt_key"]


def test_empty(frame):
    df = frame([])
    for f in (stats.pairs, stats.grounding, stats.robustness, stats.efficiency, stats.provenance, stats.warnings, stats.ranking, stats.inversions):
        assert f(df).count() == 0
