"""Annotations to report, through files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks import cli
from gaugeworks.operators import cohort, collect, corrupt, export, report
from gaugeworks.schemas import PUBLIC, RESPONSE, SCORED
from gaugeworks.sources import annotations, records
from gaugeworks.streaming import cache as stream


def source(path, n=400):
    data = {}
    for i in range(n):
        frame = data.setdefault(f"scene{i // 4}", {"scene_description": "", "key_frames": {}})["key_frames"].setdefault(f"f{i}", {"QA": {}, "image_paths": {"CAM_FRONT": f"{i}.jpg"}})
        frame["QA"] = {
            "planning": [{"Q": f"Is it safe to pass <c1,CAM_FRONT,{i}.5,2.0>?", "A": "Yes." if i % 2 else "No."}],
            "prediction": [{"Q": "Will it turn?", "A": "Yes" if i % 10 == 0 else "No"}, {"Q": "Where does it go?", "A": f"to <c1,CAM_BACK,{i},2>"}],
        }
    path.write_text(json.dumps(data))
    return str(path)


def test_annotations(spark, tmp_path):
    item = lambda q, a: {"Q": q, "A": a}
    lead = " Please select the correct answer from the following options: A. Go. B. Stop."
    data = {"s": {"scene_description": "", "key_frames": {"f": {"QA": {"planning": [item("What now?" + lead, "B"), item("And then?" + lead, "Go"), item("Why?", "Because."), item("How?" + lead, "Fly")]}, "image_paths": {}}}}}
    (tmp_path / "a.json").write_text(json.dumps(data))
    split = annotations.questions(annotations.read(spark, str(tmp_path / "a.json")))
    got = annotations.drops(split).first().asDict()
    assert got == {"total_qa": 4, "kept": 2, "not_multiple_choice": 1, "unresolvable_gold": 1, "mcq_share": 0.75}
    assert sorted(r["gold_letter"] for r in annotations.kept(split).collect()) == ["A", "B"]


def test_only_the_balanced_template_survives(spark, tmp_path):
    items = annotations.read(spark, source(tmp_path / "a.json"))
    specs = cohort.discover(items, min_total=100).collect()
    assert [(s["category"], s["options"], s["capacity"]) for s in specs] == [("planning", ["No", "Yes"], 400)]
    questions = cohort.balanced(items, cohort.discover(items, min_total=100), per_template=40)
    assert questions.count() == 40
    assert cohort.unbalanced(cohort.audit(questions)).count() == 0


def test_cohort_is_checked(spark, tmp_path):
    path = source(tmp_path / "a.json")
    args = ["--source", path, "--min-total", "100", "--per-template", "40"]
    manifest = cli.main(["cohort", *args, "--out", str(tmp_path / "c.json"), "--date", "2026-01-01", "--benchmark", "b"], spark)
    assert len(manifest["question_ids"]) == 40 and manifest["repeat_subset"]["n_questions"] == 20
    assert cohort.checked(json.loads((tmp_path / "c.json").read_text()))["cohort_id"] == manifest["cohort_id"]
    with pytest.raises(cohort.CohortError):
        cohort.checked(manifest | {"question_ids": manifest["question_ids"][:-1]})
    questions = cli.pool(spark, path, 100, 40, 0)
    assert cohort.select(questions, manifest).count() == 40
    with pytest.raises(cohort.CohortError):
        cohort.select(questions.limit(10), manifest)


def run_of(spark, questions, model, condition, seed):
    rendered = collect.prompts(questions, condition)
    planned = collect.plan(rendered, spark.createDataFrame([], RESPONSE), model, "{}", seed)
    rows = planned.select("cache_key", "question_id", "scene_id", "frame_id", "category", "letters", "gold_letter", "condition", F.size("letters").alias("n_options"), "prompt_key", "prompt_hash")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", status string, response_text string, served_model string, error_reason string, error_message string"
    done = collect.call(rows, collect.mock_reply(seed), schema)
    have = {f.name for f in done.schema}
    full = done.withColumns({"model_label": F.lit(model), "ts": F.lit(1.0), "seed": F.lit(seed), "prompt_tokens": F.lit(5)})
    return full.select(*[(F.col(f.name) if f.name in have | {"model_label", "ts", "seed"} else F.lit(None)).cast(f.dataType).alias(f.name) for f in RESPONSE])


def test_random_answers_score_at_chance(spark, tmp_path):
    questions = annotations.fixture(spark, 400)
    assert 0.25 < cohort.expected_chance(questions) < 0.5
    for model, seed in (("a", 1), ("b", 2)):
        for condition in ("clean", "corrupt"):
            records.append(run_of(spark, questions, model, condition, seed), str(tmp_path / "cache"))
    (tmp_path / "cache" / "broken.json").write_text('\n{"cache_key": "x", "sta')
    got = records.read_cache(spark, str(tmp_path / "cache"))
    assert got.count() == 1600
    again = collect.plan(collect.prompts(questions, "clean"), got, "a", "{}", 1)
    assert again.count() == 0
    records.write_scored(records.score(got, questions), str(tmp_path / "scored"))
    rows = records.read_scored(spark, str(tmp_path / "scored"))
    assert [f.name for f in SCORED] == rows.columns[:-1]
    out = cli.main(["analyze", "--scored", str(tmp_path / "scored"), "--out", str(tmp_path / "report.json"), "--n-boot", "200"], spark)
    for r in out["accuracy"]:
        assert r["n_valid"] == 400 and abs(r["accuracy"] - r["chance"]) < 0.1
    assert (tmp_path / "report.md").read_text().startswith("## warnings")
    assert {"comparisons", "robustness", "ranking"} <= out.keys() and "grounding" not in out


def test_stream_drops_keys_that_come_again(spark, tmp_path):
    questions = annotations.fixture(spark, 20)
    for _ in range(2):
        records.append(run_of(spark, questions, "a", "clean", 1), str(tmp_path / "cache"))
    q = stream.records(spark, str(tmp_path / "cache")).writeStream.format("memory").queryName("seen").outputMode("append").start()
    try:
        q.processAllAvailable()
        assert spark.sql("select * from seen").count() == 20
    finally:
        q.stop()


def public_rows(spark, **change):
    row = {f.name: None for f in SCORED} | {
        "question_id": "0123456789abcdef", "model_label": "m", "model_string": "org/m", "condition": "clean", "status": "success", "gold_letter": "A", "predicted_letter": "A", "correct": True, "valid": True,
        "extraction_method": "boxed", "prompt_tokens": 100, "completion_tokens": 50, "reasoning_tokens": 40, "reasoning_tokens_reported": True, "usd_per_1m_input": 1.0, "usd_per_1m_output": 4.05,
        "cohort_id": "a" * 64, "prompt_hash": "b" * 64, "git_sha": "123abcd", "include_sampling_params": True, "scene_id": "secret",
    }
    return spark.createDataFrame([tuple((row | change)[f.name] for f in SCORED)], SCORED)


def test_public_rows(spark, tmp_path):
    receipt = export.write(public_rows(spark), str(tmp_path / "p.jsonl"))
    got = json.loads((tmp_path / "p.jsonl").read_text())
    assert set(got) == {f.name for f in PUBLIC} and receipt["n_rows"] == 1
    assert (got["input_cost_usd"], got["output_cost_usd"], got["total_cost_usd"]) == pytest.approx((0.0001, 0.0002025, 0.0003025))
    both = public_rows(spark).union(public_rows(spark, question_id="f" * 16))
    a = export.write(both, str(tmp_path / "a"))
    assert a == export.write(both.orderBy(F.desc("question_id")).repartition(3), str(tmp_path / "b"))


@pytest.mark.parametrize("change", [{"question_id": "short"}, {"model_label": "/home/me"}, {"served_by": "bearer x"}, {"condition": "other"}, {"git_sha": None}, {"prompt_tokens": -1}, {"latency_ms": float("inf")}, {"valid": None}, {"model_string": "a\nb"}, {"price_quoted_on": "May 1"}])
def test_unsafe_rows_stop_the_export(spark, tmp_path, change):
    with pytest.raises(export.ExportError):
        export.write(public_rows(spark, **change), str(tmp_path / "p.jsonl"))
    assert not (tmp_path / "p.jsonl").exists()


def test_corruptions():
    image = np.random.default_rng(0).integers(0, 256, (64, 96, 3), dtype=np.uint8)
    for name in corrupt.REGISTRY:
        harm = [np.abs(corrupt.corrupted(image, name, s).astype(int) - image).mean() for s in corrupt.SEVERITIES]
        assert harm == sorted(harm) or name == "motion_blur"
        assert (corrupt.corrupted(image, name, 3) == corrupt.corrupted(image, name, 3)).all()
        assert corrupt.corrupted(image[:40, :40, 0], name, 2).shape == (40, 40)
    with pytest.raises(ValueError, match="no corruption"):
        corrupt.corrupted(image, "rain", 3)


def test_dash_for_what_is_undefined():
    assert report.shown(None) == report.shown(float("nan")) == report.DASH and report.shown(0.0) == "0.000"


def test_budget(spark):
    calls = spark.createDataFrame([(i, 0.4) for i in range(6)], "seq int, usd double")
    assert collect.within_budget(calls, 1.0).count() == 3


def test_sizing():
    assert collect.sizing(0, 5, 1, 4, 0.04)["questions_for_target_precision"] == 601
    assert collect.sizing(0.01, 5, 5, 4, 0.04)["binding_constraint"] == "budget"
