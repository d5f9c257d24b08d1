"""The pipeline's stages against plain versions of their decisions."""

import brute
import pyarrow.parquet as pq
import pytest
from oracle import SF

import corpus_pipeline
from gaugeworks.llm import quality


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
        out.append(docs)
    return out


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_keep_the_columns(spark, steps):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(s.columns == columns for s in steps[:-1])


def test_quality_stage(spark, steps):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    verdict = {r["doc_id"]: r["kept"] for r in quality.judge(docs, quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
    assert set(rows(steps[0])) == {d for d, k in verdict.items() if k}
    good = {r["doc_id"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist() if r["quality"] == 1}
    lost = [d for d, t in rows(docs).items() if d in good and d not in rows(steps[0]) and not brute.counts(t)[-1]]
    assert len(lost) <= 0.02 * len(good)


def test_line_stage(steps):
    before = rows(steps[0])
    gone = brute.removed_lines(list(before.items()))
    want = {}
    for d, t in before.items():
        n, removed = gone[d]
        at = {int(x) for x in removed.split(",") if x}
        if not n or n > len(at):
            want[d] = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in at)
    assert rows(steps[1]) == want


def test_near_stage(steps):
    before = rows(steps[1])
    assert rows(steps[2]) == {d: before[d] for d, (_, c) in brute.component_of(list(before.items()), 5).items() if c == d}


def test_decontamination_stage(steps):
    before = rows(steps[2])
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    found = brute.contaminated(list(before.items()), items)
    assert rows(steps[3]) == {d: t for d, t in before.items() if not found[d][-1]}


def test_tokens(steps):
    texts = rows(steps[3])
    got = {r["doc_id"]: r for r in steps[4].collect()}
    assert got.keys() == texts.keys()
    assert all(got[d]["decoded_sha256"] == brute.sha(t) for d, t in texts.items())


def test_run(spark, steps):
    assert corpus_pipeline.run(spark, SF).count() == steps[4].count()


def test_an_empty_table_passes_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
