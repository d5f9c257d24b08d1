"""Collection runs, their guards and keys, images as they are sent, the order of reports."""

import base64
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import hashing
from gaugeworks.operators import cohort, collect, corrupt, images, report, stats
from gaugeworks.schemas import SCORED
from gaugeworks.sources import annotations, records

SCHEMA = "question_id string, condition string, letters array<string>, cache_key string, status string, response_text string, served_model string, attempts int, error_reason string, error_message string"


@pytest.fixture(scope="module")
def questions(spark):
    return annotations.fixture(spark, 12).cache()


def planned(spark, questions, **more):
    none = spark.createDataFrame([], "cache_key string")
    return collect.plan(collect.prompts(questions, "clean"), none, "m", "{}", **more)


def test_every_setting_changes_the_key(spark, questions):
    base = {"seed": 1, "served_by": "a", "quantization": "fp8", "corruption": "fog", "severity": 3}
    other = {"seed": 2, "served_by": "b", "quantization": "bf16", "corruption": "motion_blur", "severity": 5}
    keys = lambda **kw: {r[0] for r in planned(spark, questions, **kw).select("cache_key").collect()}
    first = keys(**base)
    assert len(first) == 12
    for name, value in other.items():
        assert not first & keys(**{**base, name: value}), name
    assert not first & keys(**base, manifest_hash=F.lit("x"))


def test_manifest_hash(spark):
    refs = [("q", "CAM_FRONT", "p", "ab"), ("q", "CAM_BACK", "p", "cd")]
    found = images.manifests(spark.createDataFrame(refs, "question_id string, camera string, path string, source_sha256 string"))
    own = lambda edge: found.select(hashing.manifest_hash(F.col("images"), F.lit("fog"), F.lit(3), edge).alias("h")).first()["h"]
    whole = {"images": [{"camera": "CAM_BACK", "sha256": "cd"}, {"camera": "CAM_FRONT", "sha256": "ab"}], "corruption": "fog", "severity": 3, "max_edge": 0, "jpeg_quality": 90}
    import hashlib

    assert own(0) == hashlib.sha256(json.dumps(whole, sort_keys=True, separators=(",", ":")).encode()).hexdigest() != own(640)


def test_a_run_calls_what_is_planned_once(spark, questions, tmp_path):
    rows = planned(spark, questions).select("question_id", "condition", "letters", "cache_key")
    path, log = str(tmp_path / "cache"), str(tmp_path / "log.jsonl")
    told = collect.run(rows, collect.mock_reply(3), path, SCHEMA, log=log)
    assert told == {"planned": 12, "success": 12, "terminal_errors": 0, "retryable": 0}
    stored = spark.read.schema(SCHEMA).json(path)
    assert rows.join(stored, "cache_key", "left_anti").count() == 0
    line = json.loads((tmp_path / "log.jsonl").read_text())
    assert line["success"] == 12 and line["ts_iso"].endswith("+00:00")


def test_failures(spark, questions, tmp_path):
    rows = planned(spark, questions).select("question_id", "condition", "letters", "cache_key")

    def broken(row):
        raise collect.StatusError(400, "context length")

    told = collect.run(rows, collect.retrying(broken, pause=lambda s: None), str(tmp_path / "a"), SCHEMA)
    assert told["terminal_errors"] == 12
    assert {r["error_reason"] for r in spark.read.schema(SCHEMA).json(str(tmp_path / "a")).collect()} == {"http_400"}
    assert collect.run(rows, collect.mock_reply(3, fail_rate=1.0), str(tmp_path / "b"), SCHEMA)["retryable"] == 12

    def config(row):
        raise collect.ConfigError("no key")

    with pytest.raises(Exception, match="no key"):
        collect.run(rows, config, str(tmp_path / "c"), SCHEMA)


def test_tries_and_pauses():
    waited, left = [], [503, 429]

    def flaky(row):
        if left:
            raise collect.StatusError(left.pop(), retry_after="7" if len(left) == 1 else None)
        return {"response_text": "ok"}

    assert collect.retrying(flaky, pause=waited.append)({"cache_key": "k"}) == {"response_text": "ok", "attempts": 3}
    assert waited[0] == 7 and 0.5 * 1.5**2 <= waited[1] <= 1.5 * 1.5**2
    with pytest.raises(collect.RetryableError):
        collect.retrying(lambda row: (_ for _ in ()).throw(collect.StatusError(500)), tries=2, pause=lambda s: None)({})
    assert collect.backoff(50) == 60 and collect.backoff(1, "soon") == 1.5


def test_ceiling_lets_one_call_over_and_preflight_stops_all(spark, questions, tmp_path):
    rows = planned(spark, questions).select("question_id", "condition", "letters", "cache_key")
    told = collect.run(rows, collect.mock_reply(1), str(tmp_path / "a"), SCHEMA, max_usd=2.5, cost=lambda r: 1.0)
    assert told["success"] == 3
    with pytest.raises(collect.ConfigError, match="image"):
        collect.run(rows, collect.mock_reply(1), str(tmp_path / "b"), SCHEMA, preflight=lambda p: p.select("question_id"))
    assert not (tmp_path / "b").exists()


def test_settings_that_cannot_be_meant():
    for bad in ({"max_usd": 1.0}, {"n_questions": -1}, {"temperature": 3}, {"max_tokens": 0}):
        with pytest.raises(collect.ConfigError):
            collect.checked_run(**bad)
    collect.checked_run(10, 15, 1.0, 0.5, 2.0, temperature=0, max_tokens=64)


def test_trees_with_changes_are_refused(tmp_path):
    import subprocess

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b.c", *a], check=True, capture_output=True)
    git("init")
    (tmp_path / "x").write_text("1")
    git("add", "x")
    git("commit", "-m", "x")
    assert len(collect.clean_tree(str(tmp_path))) == 40
    (tmp_path / "x").write_text("2")
    with pytest.raises(collect.ConfigError):
        collect.clean_tree(str(tmp_path))


def test_prompts_and_messy_replies(spark, questions):
    p = collect.Prompt("n", "v2", "s", "Q {question} O {options_block}")
    got = collect.prompts(questions, "clean", p).first()
    assert got["prompt_key"] == "n@v2" and got["prompt_user"].startswith("Q " + got["stem"] + " O A. ") and got["prompt_hash"] == p.hash
    u = [0.0, 0.2, 0.4, 0.6, 0.7, 0.85, 0.95]
    said = [r[0] for r in spark.createDataFrame([(x,) for x in u], "u double").select(collect.messy(F.lit("B"), F.lit("Stop"), F.col("u"))).collect()]
    assert len(set(said)) == 7 and said[-1] == "I think it will Stop"


def test_samples_and_limits(spark, questions):
    ids = lambda df: [r[0] for r in df.select("question_id").collect()]
    assert len(ids(collect.sampled(questions, 5, 1))) == 5 and ids(collect.sampled(questions, 5, 1)) == ids(collect.sampled(questions.repartition(3), 5, 1)) != ids(collect.sampled(questions, 5, 2))
    assert ids(collect.limited(questions, 3)) == sorted(ids(questions))[:3] and len(ids(collect.limited(questions, 0))) == 12


def test_the_last_argument_wins(spark, tmp_path):
    for name, letter in (("b", "A"), ("a", "B")):
        rows = spark.createDataFrame([tuple({"question_id": "q", "model_label": "m", "condition": "clean", "predicted_letter": letter}.get(f.name) for f in SCORED)], SCORED)
        records.write_scored(rows, str(tmp_path / name))
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    last = lambda *paths: stats.last_answers(records.read_scored(spark, *paths), ["question_id"]).first()["predicted_letter"]
    assert last(a, b) == "A" and last(b, a) == "B"


def test_selecting_again_checks_source_and_audit(spark):
    rows = [(f"{i:02d}", "c", "t", "yes" if i % 2 else "no", "AB"[i // 2 % 2]) for i in range(16)]
    pool = spark.createDataFrame(rows, "question_id string, category string, template_id string, gold_text string, gold_letter string")
    manifest = cohort.freeze(pool, "b", "a", {"sha256": "x"}, {"seed": 1}, "2026-01-01", 2)
    assert [r["pos"] for r in cohort.reselect(pool, manifest, "x").collect()] == list(range(16))
    with pytest.raises(cohort.CohortError, match="source"):
        cohort.reselect(pool, manifest, "y")
    with pytest.raises(cohort.CohortError, match="audit"):
        cohort.reselect(pool.withColumn("gold_letter", F.when(F.col("question_id") == "00", "B").otherwise(F.col("gold_letter"))), manifest, "x")
    assert cohort.drift(manifest, seed=1) == [] and len(cohort.drift(manifest, seed=2)) == 1


def test_fog_is_the_scattering_formula():
    """Golden pixels: knots by hand on an image so small that every octave has two knots along an edge."""
    image = np.full((2, 2, 3), 100, np.uint8)
    for severity, (b, air) in enumerate(corrupt.FOG, 1):
        rng = corrupt.generator("fog", severity, 0)
        grids = [rng.random((2, 2)).astype(np.float32) for _ in range(4)]
        field = sum(g * 0.5**o for o, g in enumerate(grids))
        field = (field - field.min()) / (field.max() - field.min())
        t = np.exp(-b * 3 * (1 - (0.5 + 0.5 * field)))
        want = np.clip((100 / 255 * t + air * (1 - t)) * 255 + 0.5, 0, 255).astype(np.uint8)
        assert np.abs(corrupt.corrupted(image, "fog", severity)[:, :, 0].astype(int) - want).max() <= 1


def test_golden_pixels():
    image = np.arange(64 * 96 * 3).reshape(64, 96, 3).astype(np.uint8)
    assert corrupt.corrupted(image, "brightness", 3)[10, 10].tolist() == [171, 172, 173]
    assert corrupt.corrupted(np.full((40, 40), 77, np.uint8), "motion_blur", 5).tolist() == np.full((40, 40), 77).tolist()
    noise = np.random.default_rng(int(__import__("hashlib").sha256(b'{"corruption":"gaussian_noise","seed":0,"severity":3}').hexdigest()[:16], 16)).normal(0, 0.10, image.shape)
    assert (corrupt.corrupted(image, "gaussian_noise", 3) == np.clip((image / 255.0 + noise) * 255 + 0.5, 0, 255).astype(np.uint8)).mean() > 0.99


def test_images_as_they_are_sent(spark):
    image = np.zeros((48, 31, 3), np.uint8)
    image[:, :, 0], image[24:, :, 2] = 200, 90
    assert (images.from_bmp(images.to_bmp(image)) == image).all()
    data = images.jpeg(spark, image)
    assert data[:2] == b"\xff\xd8" and np.abs(images.decode(spark, data).astype(int) - image).mean() < 4
    assert images.decode(spark, data, max_edge=24).shape == (24, 15, 3)
    head, _, body = images.data_url(spark, data, "brightness", 5).partition(",")
    assert head == "data:image/jpeg;base64" and images.decode(spark, base64.b64decode(body)).mean() > image.mean() + 50


def test_report_formats_and_order():
    assert (report.pct(0.1234), report.usd(None), report.pval(0.00001), report.ci(0.1, float("nan"))) == ("12.3%", report.DASH, "<0.0001", report.DASH)
    rows = [{"condition": "c", "pair": p, "delta": d} for p, d in (("a vs b", 0.1), ("a vs c", -0.4), ("b vs c", 0.1))]
    assert [r["pair"] for r in sorted(rows, key=report.ORDER_OF["comparisons"])] == ["a vs c", "a vs b", "b vs c"]
