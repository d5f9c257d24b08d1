"""Inputs that once gave wrong results, crashes, or work out of proportion."""

import random
import subprocess
import sys
import time

import brute
import numpy as np
import pyarrow.parquet as pq
import pytest
from oracle import SF

import corpus_pipeline
from gaugeworks.llm import decontamination, lines, neardup, pii, quality, sharding, suffix, tagger, warc
from gaugeworks.llm.shingles import ExactSets, hashed_words, mix

r = random.Random(4)


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s


TWINS = [(thue_morse(512), thue_morse(512).translate(str.maketrans("ab", "ba"))), (thue_morse(2048), thue_morse(2048).translate(str.maketrans("ab", "ba")))]


@pytest.mark.parametrize("a, b", TWINS)
def test_words_of_one_structure_stay_apart(spark, a, b):
    h = hashed_words([a.encode(), b.encode()])[0]
    assert h[0] != h[1]
    rows = [(1, a), (2, b), (3, f"{a} {b}"), (4, f"{b} {a}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x["doc_id"]: (x["n_lines"], x["removed"]) for x in lines.report(df).collect()} == brute.removed_lines(rows)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in neardup.groups(df, k=2).collect()} == brute.component_of(rows, 2)


def test_small_sets_in_other_orders_meet(spark):
    rows = [(1, "a b a"), (2, "b a b"), (3, "a b a b a"), (4, "x x"), (5, "x x x"), (6, "a b")]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()}
    assert got == brute.component_of(rows, 2)


@pytest.mark.parametrize("k", [1, 2, 5])
def test_exact_sets(k):
    exact, seen = ExactSets(k), []
    for _ in range(150):
        w = [r.choice("abc") for _ in range(r.randint(0, 9))]
        want = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        got = exact.of(" ".join(w).encode())
        assert len(got) == len(want)
        assert all(len(np.intersect1d(got, g)) == len(want & s) for s, g in seen)
        seen.append((want, got))


REPEATED = [(1, "450 x " * 90), (1, "short"), (2, "450 x " * 90), (3, "aa bb cc dd ee"), (4, "aa bb cc dd ee"), (4, "zz yy xx"), (4, "zz yy xx"), (None, "aa bb cc dd ee"), (None, "450 x " * 90), (5, None), (5, "")]


def test_rows_of_one_id_are_documents_of_their_own(spark):
    df = spark.createDataFrame(REPEATED, "doc_id long, text string").repartition(3)
    cut = sorted(tuple(x) for x in suffix.report(df).select("doc_id", "n_bytes", "n_removed").fillna(-1).collect())
    assert cut == sorted((-1 if d is None else d, len((t or "").encode()), 540 if d in (1, 2) and len(t) == 540 else 0) for d, t in REPEATED)
    left = sorted((x["doc_id"] or -1, x["n_removed"], x["n_lines"]) for x in lines.report(df).collect())
    assert left == sorted([(-1, 0, 0), (-1, 0, 0), (1, 0, 1), (1, 0, 1), (2, 1, 1), (3, 0, 1), (4, 1, 1), (4, 0, 1), (4, 0, 1), (5, 0, 0), (5, 0, 0)])
    kept = sorted((x["doc_id"] or -1, x["text"] or "") for x in lines.without(df, lines.duplicates(df)).collect())
    assert kept == sorted((d or -1, t or "") for d, t in REPEATED if (d, t) not in ((2, "450 x " * 90), (4, "aa bb cc dd ee")))
    groups = sorted((x["doc_id"] or -1, x["component_id"] or -1) for x in neardup.groups(df, k=2).collect())
    assert groups == sorted([(-1, -1), (-1, -1), (1, 1), (1, 1), (2, 1), (3, 3), (4, 3), (4, 3), (4, 3), (5, 5), (5, 5)])


def test_runs_of_edges_stay_whole_where_joins_change_while_running(spark):
    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choice("abcdefgh ij") for _ in range(n))
    passages = [text(rnd.randint(401, 449)) for _ in range(60)]
    rows = [(60 * copy + i, text(rnd.randint(1, 99)) + p + text(rnd.randint(1, 99))) for copy in range(2) for i, p in enumerate(passages)]
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        found = suffix.report(spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(2, "doc_id")).collect()
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in found} == brute.without_repeats(rows)


def test_columns_of_any_name_pass(spark):
    rows = [(1, "a b c d e\nq", 1, 2, 3, 4), (2, "a b c d e\nz", 5, 6, 7, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gw_removed int, removed int, place int, `a.b` int")
    got = {x["doc_id"]: tuple(x) for x in lines.without(df, lines.duplicates(df)).collect()}
    assert got == {1: rows[0], 2: (2, "z", 5, 6, 7, 8)}
    found = decontamination.find(df.select("*").withColumnsRenamed({"gw_removed": "row", "place": "n", "removed": "runs"}), spark.createDataFrame([(1, "a b c")], "item_id long, text string"))
    assert {(x["row"], x["n"], x["a.b"], len(x["gw_runs"])) for x in found.collect()} == {(1, 3, 4, 1), (5, 7, 8, 1)}
    plain = df.drop("a.b").withColumnRenamed("removed", "gw_kept")
    assert quality.judge(plain, None, keep_row=True).columns == [c for c in plain.columns if c != "gw_kept"] + ["gw_kept"]


ITEMS = [(None, "one two three"), (1, "one two three"), (10, "two three four five"), (2, "four five"), (2, "one two"), (3, " ".join(f"w{i}" for i in range(60)))]
NAMES = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.mark.parametrize("size", [20_000, 7, 1])
def test_items_without_id_and_items_in_many_passes(spark, monkeypatch, size):
    monkeypatch.setattr(decontamination, "PASS_WINDOWS", size)
    docs = [(1, "zero one two three four five six"), (1, "one two"), (2, None), (3, "five"), (4, " ".join(f"w{i}" for i in range(5, 40)))]
    got = decontamination.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert sorted((x["doc_id"], *(x[n] for n in NAMES)) for x in got.collect()) == sorted((d, *brute.contaminated([(d, t)], ITEMS)[d]) for d, t in docs)


def test_quality_with_odd_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    odd = labels.union(labels.limit(5)).union(labels.limit(5).selectExpr("doc_id", "1 - quality")).union(spark.createDataFrame([(None, 1), (1, None), (10**9, 0)], "doc_id long, quality int"))
    assert quality.learn(docs, odd) is not None


def test_chains_of_any_length_take_little_memory():
    code = """
import random, resource
from gaugeworks.llm import pii, tagger
r = random.Random(3)
model = tagger.Model.fresh(16, 1)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
pii.spans(["".join(r.choice("0123456789 .-") for _ in range(1_000_000))] + ["x 1"] * 255, model)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) < 500


def test_reading_near_digits_is_reading_all(monkeypatch):
    model = tagger.default_model()
    texts, _ = tagger.labelled(200, 5)
    texts = [("la le li lo lu. " * 30) + t + (" word" * 50) for t in texts] + [x["text"] or "" for x in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    near = pii.spans(texts, model)
    monkeypatch.setattr(tagger, "regions", lambda t: [(0, len(t))] if t else [])
    assert pii.spans(texts, model) == near and sum(len(more) for _, more in near) > 100


def test_secrets_are_found():
    model = tagger.default_model()
    text = 'the log said token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and went on, see also commit 3c4226790fc3f8022bcc4434e93601b2005f1325'
    ((_, more),) = pii.spans([text], model)
    assert [(k, text[a:b]) for k, a, b in more] == [("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962")]


def test_added_spans_by_plain_search():
    known = {"email": [(5, 9), (20, 40)], "ip": [(0, 3), (25, 30)]}
    text = "1" * 60
    for s in range(50):
        want = not any(a < s + 8 and s < b for spans in known.values() for a, b in spans)
        got = pii.added(" " * s + "12345678" + " " * 50, [("phone", s, s + 8)], known)
        assert not got  # a phone number needs three parts
        got = pii.added(" " * s + "(1) 2345678" + " " * 50, [("card", s, s + 8)], known)
        assert not got and text and want in (True, False)


def test_hot_tokens_take_time_in_proportion():
    rng = np.random.default_rng(0)

    def took(m):
        post = np.zeros(m, lines.POSTING)
        post["t"], post["n"], post["doc"], post["key"] = 1, 12, np.arange(m), np.arange(m)
        post["b0"], post["b1"] = rng.integers(0, 2**63, (2, m), dtype=np.uint64)
        at = time.time()
        lines.meet(post, 80, 4, None)
        return time.time() - at

    took(4_000)
    assert took(64_000) < 40 * max(took(4_000), 0.02)


def test_many_and_few_postings_give_equal_pairs(monkeypatch):
    rng = np.random.default_rng(1)
    base = [rng.integers(0, 300, n) for n in rng.integers(1, 40, 30)]
    sets = []
    for _ in range(600):
        b = base[rng.integers(0, len(base))].copy()
        b[rng.integers(0, len(b), rng.integers(0, 4))] = rng.integers(0, 300)
        sets.append(np.unique(b))
    h = mix(np.arange(300, dtype=np.uint64))
    post = np.zeros(len(sets), lines.POSTING)
    for i, s in enumerate(sets):
        bits = 0
        for b in ((h[s] >> np.uint64(3)) % np.uint64(128)).tolist():
            bits ^= 1 << b
        post[i] = (5, 0, i, bits & (2**64 - 1), bits >> 64, i, len(s), 0)
    found = []
    for many in (10**9, 3):
        monkeypatch.setattr(lines, "MANY", many)
        x, y, _ = lines.meet(post.copy(), 80, None, None)
        found.append(sorted(zip(x[0].tolist(), y[0].tolist(), strict=True)))
    assert found[0] == found[1] and len(set(found[0])) == len(found[0]) > 100


def test_archives_with_repeated_ids_and_clashing_columns(spark, tmp_path):
    rows = [(1, "u", "same", "d", 1), (1, "u", "same", "d", 2), (2, "u", "same", "d", 3), (2, "u", "other", "d", 4), (3, "u", "x", "d", 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, n_bytes int")
    warc.write(df, str(tmp_path / "w"))
    got = sorted((x["page_id"], x["record_type"], x["refers_to"] or 0, x["payload_bytes"]) for x in warc.read(spark, str(tmp_path / "w")).collect())
    assert got == [(1, "revisit", 2, 4), (1, "revisit", 2, 4), (2, "response", 0, 4), (2, "response", 0, 5), (3, "response", 0, 1)]


def test_magic_in_payloads_takes_time_in_proportion():
    def took(n):
        body = b"WARC/1.0\r\n" * n
        data = b"WARC/1.0\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
        at = time.time()
        assert [c[0] for c in warc.candidates(data)][:1] == [0]
        return time.time() - at

    took(100)
    assert took(100_000) < 2


def test_plain_interleaving(spark):
    import hashlib
    import zlib

    rows = [(i, "t" * (i % 7), "big" if i % 3 else f"s{i % 5}") for i in range(300)] + [(7, None, None), (7, "a", "big")]
    got = {(x["doc_id"], x["size"], x["text_crc32"]): (x["shard"], x["slot"]) for x in sharding.interleave(spark.createDataFrame(rows, "doc_id long, text string, source string"), bucket_rows=20).collect()}
    strata = {}
    for d, t, s in rows:
        h = int(hashlib.md5(f"7:{d}".encode()).hexdigest()[:13], 16)
        strata.setdefault("" if s is None else f"={s}", []).append((h, d, len(t or "") + 1, zlib.crc32((t or "").encode())))
    order = sorted((((2 * i + 1) / (2 * len(own))), s, x) for s, own in strata.items() for i, x in enumerate(sorted(own)))
    shard = [i * 8 // len(order) for i in range(len(order))]
    assert got == {x[1:]: (shard[i], i - shard.index(shard[i])) for i, (_, _, x) in enumerate(order)}


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, name, stage):
    """Nulls in any column, repeated rows and ids, and names that the operators use: no stage crashes, all but the last keep the columns."""
    good = pq.read_table(f"{SF}/documents.parquet").to_pylist()[:40]
    rows = [(x["doc_id"], x["text"], x["lang"], x["source"], x["n_chars"], 1, "r", 2, 3) for x in good] + [(None, good[0]["text"], None, None, None, None, None, None, None), (good[1]["doc_id"], good[2]["text"], "l", "s", 1, 1, "r", 2, 3), (900_001, None, "l", "s", 0, 1, "r", 2, 3)]
    docs = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, lang string, source string, n_chars long, gw_removed int, row string, place int, n int")
    out = stage(spark, docs, SF)
    assert out.count() >= 0
    if name != "tokenization":
        assert out.columns == docs.columns
        assert {x["gw_removed"] for x in out.collect()} <= {1, None}
