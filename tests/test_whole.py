"""Queries that read the whole of their input, against plain loops over it."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from oracle import SF, connection

from gaugeworks.functions import text
from gaugeworks.operators import collect, report
from gaugeworks.plans import analysis, registry, textual  # noqa: F401
from gaugeworks.plans.testdata import SCORED, scored


def test_probe_reads_whole_texts(spark):
    tails = [" Please select the correct answer from the following options: A. Go B. Stop", " (A) Go", "\n  A. x", " option A: y"]
    want = Counter()
    for i, source, lang, body in duckdb.sql(f"select doc_id, source, lang, text from '{SF}/documents.parquet'").fetchall():
        question, answer = body + tails[i % 4], [" B. ", "C) go", source][i % 3]
        for on, patterns in ((question, text.PATTERNS), (answer, text.GOLD_PATTERNS)):
            want.update({(lang, k): int(bool(re.search(p, on, re.ASCII))) for k, p in patterns.items()})
    got = {(r["lang"], r["pattern"]): r["n"] for r in registry.QUERIES["probe_patterns_whole"](spark, SF).collect()}
    assert got == dict(want)
    assert got["en", "letter_dot_A"] == 64  # 62 in the first 200 characters


def paired(sf_dir, also):
    """(model_label: two lists of flags) by question over the last rows, by the SQL of scored rows."""
    con = connection(sf_dir)
    last: dict = {}
    for model, condition, question, correct in con.sql(f"with {SCORED} select model_label, condition, question_id, correct from last_rows").fetchall():
        last.setdefault(model, {}).setdefault(condition, {})[question] = float(bool(correct))
    out = {}
    for model, by in last.items():
        if shared := sorted(set.intersection(*[set(by.get(c, {})) for c in also])):
            out[model] = [np.array([by[c][q] for q in shared]) for c in also]
    return out


def interval(x, y, n_boot=10_000):
    idx = np.random.default_rng(0).integers(0, len(x), size=(n_boot, len(x)))
    return tuple(np.percentile(x[idx].mean(axis=1) - y[idx].mean(axis=1), [2.5, 97.5]))


@pytest.mark.parametrize(("name", "conditions"), [("grounding_interval", ["clean", "blind_notags", "blind_tags"]), ("robustness_interval", ["clean", "corrupt"])])
def test_paired_intervals(spark, name, conditions):
    sf_dir = SF.replace("0.001", "0.01")
    want = {m: interval(*v[:2]) for m, v in paired(sf_dir, conditions).items()}
    assert want
    got = {r[0]: r[1:] for r in registry.QUERIES[name](spark, sf_dir).collect()}
    assert got.keys() == want.keys()
    for m in want:
        assert got[m] == pytest.approx(want[m], abs=1e-8)


def test_report_has_the_intervals(spark):
    sf_dir = SF.replace("0.001", "0.01")
    out = report.sections(scored(spark, sf_dir), n_boot=200)
    for section, value, names in (("grounding", "grounding_gap", ("gap_ci_low", "gap_ci_high")), ("robustness", "delta", ("delta_ci_low", "delta_ci_high"))):
        assert out[section]
        for r in out[section]:
            assert r[names[0]] <= r[value] <= r[names[1]]


def test_determinism_takes_all_replies_with_their_status(spark, monkeypatch):
    seen = {}

    def determinism(a, b, real=collect.determinism):
        seen["rows"] = a.count() + b.count()
        return real(a, b)

    monkeypatch.setattr(collect, "determinism", determinism)
    got = registry.QUERIES["determinism_compare"](spark, SF).first()
    replies = connection().sql("select count(*) from events where event_type in ('view', 'click')").fetchall()[0][0]
    assert seen["rows"] == replies and got["n_compared"] > 0


def test_determinism_takes_the_last_success(spark):
    frame = lambda rows: spark.createDataFrame(rows, "question_id long, response_text string, status string, seq long")
    a = frame([(1, "x", "success", 1), (1, "y", "success", 2), (1, "z", "terminal_error", 3), (2, "x", "terminal_error", 4)])
    b = frame([(1, "y", "success", 1), (2, "x", "success", 2)])
    assert tuple(collect.determinism(a, b).first()) == (1, 1, 1.0)


def test_corruptions_use_all_values_of_all_vectors(spark, tmp_path):
    vectors = {1: [0.001 * i for i in range(1, 65)], 2: [0.5] * 5, 3: [0.25] * 48}
    spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.QUERIES["corruptions"](spark, str(tmp_path)).where("corruption = 'brightness' and severity = 1").collect()
    assert {r["image_id"]: len(r["pixels"]) for r in got} == {1: 72, 2: 12, 3: 48}
    shift = lambda x: int(np.clip((x / 255 + 0.1) * 255 + 0.5, 0, 255))
    for r in got:
        own = [int(abs(np.float32(x)) * np.float32(1000)) % 256 for x in vectors[r["image_id"]]]
        want = [shift(x) for x in own + [0] * (len(r["pixels"]) - len(own))]
        assert np.abs(np.array(want) - r["pixels"]).max() <= 1
