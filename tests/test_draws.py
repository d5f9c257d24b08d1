"""Bootstrap draws from MD5, against a loop with hashlib."""

import hashlib

import numpy as np
import pytest
from oracle import SF

from gaugeworks.functions.md5 import draws
from gaugeworks.operators import stats
from gaugeworks.plans import analysis, collection, registry  # noqa: F401


def drawn(seed, b, n):
    return [int(hashlib.md5(f"{seed}|{b}|{i}".encode()).hexdigest()[:8], 16) for i in range(n)]


@pytest.mark.parametrize(("seed", "n"), [(0, 0), (0, 1), (0, 10), (0, 11), (-7, 1003), (123456, 10_017)])
def test_draws_are_those_of_hashlib(seed, n):
    got = {b: [] for b in range(8, 103, 31)}
    for b, x in draws(seed, range(8, 103, 31), n, chunk=1000):
        got[b] += x.tolist()
    assert got == {b: drawn(seed, b, n) for b in got}


def interval(values, n_boot):
    """As SQL: a sum leaves nulls out, and is null over nulls only; a percentile leaves null means out."""
    n, means = len(values), []
    for b in range(n_boot):
        own = [v for v in (values[x % n] for x in drawn(0, b, n)) if v is not None]
        if own:
            means.append(sum(own) / n)
    return tuple(np.percentile(means, [2.5, 97.5])) if means else (None, None)


@pytest.mark.parametrize(("n_boot", "parts"), [(25, 4), (3, 10)])
def test_hash_bootstrap(spark, n_boot, parts):
    groups = {1: [float(i % 3 == 0) for i in range(1234)], 2: [float(i % 3 - 1) for i in range(57)], 3: [2.5], 4: [None, 1.0, None], 5: [None]}
    rows = [(k, f"{i:05}", v) for k, vs in groups.items() for i, v in enumerate(vs)] + [(None, "1", 1.0)]
    df = spark.createDataFrame(rows[::-1], "g int, at string, v double")
    got = {r["g"]: (r["ci_low"], r["ci_high"]) for r in stats.hash_bootstrap(df, "g", "v", "at", n_boot=n_boot, block=100, parts=parts).collect()}
    assert got.keys() == groups.keys()
    for g, values in groups.items():
        assert got[g] == pytest.approx(interval(values, n_boot), abs=1e-12)


def rows_made(df):
    """The most rows that a step of the plan made."""
    made = []

    def walk(node):
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            node = node.executedPlan()
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            node = node.plan()
        if node.metrics().contains("numOutputRows"):
            made.append(node.metrics().apply("numOutputRows").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    assert df.collect()
    walk(df._jdf.queryExecution().executedPlan())
    return max(made)


def test_no_row_is_made_for_a_draw(spark):
    df = spark.range(0, 20_000, 1, 4).selectExpr("'m' as g", "id", "cast(id % 2 as double) as v")
    assert rows_made(stats.hash_bootstrap(df, "g", "v", "id", n_boot=50)) == 20_000


@pytest.mark.parametrize("name", ["grounding_ci", "robustness_ci", "hash_bootstrap_ci"])
def test_queries_make_no_more_rows_than_events(spark, name):
    assert rows_made(registry.QUERIES[name](spark, SF)) == spark.read.parquet(f"{SF}/events.parquet").count()
