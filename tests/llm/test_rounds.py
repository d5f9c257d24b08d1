"""Line dedup where a token is frequent, and its second round."""

import random
import time

import brute
import numpy as np
import pytest

from gaugeworks.llm import lines


def test_frequent_tokens_of_lines_of_many_lengths_take_little_time():
    rng = np.random.default_rng(0)

    def took(m):
        post = np.zeros(m, lines.POSTING)
        post["t"], post["n"], post["doc"], post["key"] = 1, rng.integers(20, 160, m), np.arange(m), lines.mix(np.arange(m, dtype=np.uint64))
        post["b0"], post["b1"] = rng.integers(0, 2**63, (2, m), dtype=np.uint64)
        at = time.thread_time()
        lines.meet(post, 80, 4, None)
        return time.thread_time() - at

    took(1_000)
    assert took(4_000) < 30 * max(took(1_000), 0.02)


def test_blocks_keep_the_first_partners_of_a_group_and_name_the_others():
    m = 3_000
    post = np.zeros(m, lines.POSTING)
    post["t"], post["n"], post["doc"], post["key"] = 1, 20, np.arange(m), lines.mix(np.arange(m, dtype=np.uint64))
    x, y, more = lines.meet(post, 80, 4, None)
    assert (x[0] < y[0]).all() and sorted(more[0].tolist()) == list(range(5, m))
    assert np.bincount(y[0], minlength=m).tolist() == [0, 1, 2, 3] + [4] * (m - 4)


@pytest.mark.parametrize(("most", "rounds"), [(20_000, 1), (0, 2)])
def test_second_round_of_few_lines_and_of_many(spark, monkeypatch, most, rounds):
    r, called, real = random.Random(3), [], lines.candidates
    monkeypatch.setattr(lines, "FIRST_CANDIDATES", 0)
    monkeypatch.setattr(lines, "SECOND_LINES", most, raising=False)
    monkeypatch.setattr(lines, "candidates", lambda *a: called.append(a) or real(*a))
    base = [[f"w{r.randrange(80)}" for _ in range(n)] for n in (1, 2, 4, 5, 9, 20, 60, 400)]
    change = lambda b: " ".join(w if r.random() > 0.06 else f"w{r.randrange(80)}" for w in b)
    rows = [(i, "\n".join(change(r.choice(base)) for _ in range(4))) for i in range(70)]
    got = lines.report(spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string")).where("doc_id is not null")
    assert {x["doc_id"]: (x["n_lines"], x["removed"]) for x in got.collect()} == brute.removed_lines(rows)
    assert len(called) == rounds


def test_classes_of_equal_lines_are_dealt_in_blocks_and_a_common_key_once_a_flush(spark, monkeypatch):
    monkeypatch.setattr(lines, "FLUSH_BYTES", 40 * lines.KEYED.itemsize)
    monkeypatch.setattr(lines, "CACHE_BYTES", 400)
    rows = [(i, f"the same line\nline of {i % 70}\n\nthe  Same line\n{i} alone") for i in range(400)]
    docs = spark.createDataFrame(rows, "id long, text string").selectExpr("id", "id as own", "xxhash64(text) as text_hash", "text").repartition(4)
    counted = lines.keys_and_counts(docs).persist()
    dealt = [np.frombuffer(r["keys"], lines.KEYED) for r in counted.where("part >= 0").collect()]
    assert all(len(set(zip(x["k0"].tolist(), x["k1"].tolist(), strict=True))) == len(x) for x in dealt) and sum(map(len, dealt)) < 1_200
    got = {(r["doc"], r["line"]) for r in lines.repeats(counted).collect()}
    assert got == {(i, k) for i in range(400) for k in (0, 1, 3) if (i, k) != (0, 0) and (k != 1 or i >= 70)}
    assert lines.repeats(counted).count() == len(got)
