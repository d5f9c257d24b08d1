"""Each operator against its plain version, on the smallest table and on rows with nulls, ties, repeats, empty and long texts."""

import random
import re

import brute
import numpy as np
import pyarrow.parquet as pq
import pytest
from oracle import SF, compare
from pyspark.sql import functions as F

from gaugeworks.llm import bpe, chat, decontamination, lines, neardup, pii, quality, queries, sharding, suffix, tagger, warc
from gaugeworks.llm.components import components

r = random.Random(11)


def words(n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def changed(text, share):
    return " ".join(w if r.random() > share else f"x{r.randrange(10**6)}" for w in text.split(" "))


BASES = [words(n) for n in (6, 30, 120, 400)]
ODD = [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "one two"), (905, "One TWO"), (906, BASES[1]), (907, BASES[1].upper()), (908, words(30_000, 5000)), (909, "é" * 500), (910, " x ")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    rows = [(d, t) for d, t in rows if d < 900] + ODD + [(1000 + i, changed(b, s)) for i, (b, s) in enumerate((b, s) for b in BASES for s in (0, 0.02, 0.05, 0.1, 0.2) for _ in range(4))]
    return rows


@pytest.fixture(scope="module")
def frame(spark, docs):
    # columns whose names the operators use themselves must not matter
    return spark.createDataFrame([(d, t, 1, 2, "k", "s") for d, t in docs], "doc_id long, text string, id int, n int, key string, source string").repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def by_id(df, *names):
    return {x["doc_id"]: tuple(x[n] for n in names) for x in df.collect()}


@pytest.mark.parametrize("k", [2, 5])
def test_neardup(frame, docs, empty, k):
    assert by_id(neardup.groups(frame, k=k), "n_shingles", "component_id") == brute.component_of(docs, k)
    assert neardup.groups(empty).count() == 0


def test_neardup_large_family(spark):
    """Copies that mostly aren't similar to each other need the later rounds."""
    base = words(60, 10**6)
    rows = [(i, changed(base, r.uniform(0.02, 0.2))) for i in range(150)]
    got = by_id(neardup.groups(spark.createDataFrame(rows, "doc_id long, text string"), k=2), "n_shingles", "component_id")
    assert got == brute.component_of(rows, 2)


def test_sketch_estimates():
    rng = np.random.default_rng(0)
    for n in (40, 400, 4000):
        a = np.unique(rng.integers(0, 2**63, n, np.uint64) * np.uint64(2))
        b = np.unique(np.r_[a[: n * 9 // 10], rng.integers(0, 2**63, n // 10, np.uint64)])
        (_, x), (_, y) = neardup.opened([neardup.sketch(a)]), neardup.opened([neardup.sketch(b)])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((x == y).mean() - true) < 5 * (0.25 / min(256, n)) ** 0.5
        assert neardup.likely((x == y).sum(axis=1), np.array([n]), true)[0]


def test_components(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 101), (50, 50), (101, 100), (100, 7)]
    got = {x["id"]: x["label"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {100: 0, 101: 0}


def test_lines(frame, docs, empty):
    report = lines.report(frame)
    assert by_id(report, "n_lines", "removed") == brute.removed_lines(docs)
    assert lines.report(empty).count() == 0


def test_lines_second_round(spark, monkeypatch):
    monkeypatch.setattr(lines, "FIRST_CANDIDATES", 0)
    base = [words(n, 60) for n in (1, 2, 4, 5, 20, 60)]
    rows = [(i, "\n".join(changed(r.choice(base), r.choice([0, 0.05, 0.15])) for _ in range(4))) for i in range(60)]
    assert by_id(lines.report(spark.createDataFrame(rows, "doc_id long, text string")), "n_lines", "removed") == brute.removed_lines(rows)


def test_lines_without(spark):
    rows = [(1, "a b c d e\nx y\n", 1), (2, "x Y\nz z\n\n", 2), (3, "a b c d e\nx y", 3), (4, "", 4), (5, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, more int")
    got = {x["doc_id"]: x["text"] for x in lines.without(df, lines.duplicates(df)).collect()}
    assert got == {1: "a b c d e\nx y\n", 2: "z z\n\n", 4: "", 5: None}


def test_suffix(frame, docs, empty):
    assert by_id(suffix.report(frame), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.without_repeats(docs)
    assert suffix.report(empty).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_edges(spark, seed):
    rnd = random.Random(seed)
    text = lambda n: "".join(rnd.choice("abcdefgh ij\né") for _ in range(n))
    passages = [text(rnd.randint(380, 1200)) for _ in range(8)]
    rows = [(100, "a" * 1000), (101, "ab" * 700), (102, "a" * 399), (103, "a" * 400), (106, passages[0] * 3), (107, passages[0]), (108, passages[1][:400] + "x"), (109, "y" + passages[1][:400])]
    for d in range(40):
        t = text(rnd.randint(0, 300))
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            p = p[rnd.randint(0, 100) : len(p) - rnd.randint(0, 100)]
            if rnd.random() < 0.4:
                i = rnd.randrange(len(p))
                p = p[:i] + "#" + p[i + 1 :]
            t += p + text(rnd.randint(0, 50))
        rows.append((d, t))
    assert by_id(suffix.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.without_repeats(rows)


def test_decontamination(spark, frame, docs, empty):
    long = words(14)
    items = [(1, long), (2, "Two words"), (3, None), (4, "?!"), (5, long), (10, words(300)), (6, docs[0][1] or "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    more = [(2000, f"x {long.upper()} y"), (2001, "two,WORDS two words"), (2002, long[: len(long) // 2]), (2003, " ".join(long.split()[2:12]))]
    both = frame.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    names = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert by_id(decontamination.report(both, bench), *names) == brute.contaminated(docs + more, items)
    assert decontamination.report(empty, bench).count() == 0
    assert not any(x["contaminated"] for x in decontamination.report(frame, bench.limit(0)).collect())


def test_decontamination_in_passes(spark, frame, docs, monkeypatch):
    monkeypatch.setattr(decontamination, "PASS_WINDOWS", 5)
    items = [(i, words(14)) for i in range(3)] + [(9, docs[1][1])]
    names = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    got = by_id(decontamination.report(frame, spark.createDataFrame(items, "item_id long, text string")), *names)
    assert got == brute.contaminated(docs, items)


def test_quality(spark, frame, docs, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    trees = quality.learn(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    got = by_id(quality.judge(frame, trees), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == {d: brute.counts(t) for d, t in docs}
    assert quality.judge(empty, trees).count() == 0
    assert quality.learn(empty, labels) is None
    assert all(x["kept"] != x["base_failed"] for x in quality.judge(frame, None).collect())


def test_quality_trees():
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(quality.FEATURES)))
    y = (x[:, 0] + x[:, 2] * -2 + rng.normal(0, 0.1, 3000) > -0.4).astype(float)
    trees = quality.fit(x[:2000], y[:2000])
    assert ((trees.score(x[2000:]) > 0) == y[2000:]).mean() > 0.9
    for j in np.flatnonzero(quality.MONOTONE):
        up = x[2000:].copy()
        up[:, j] += rng.random(1000)
        assert (quality.MONOTONE[j] * (trees.score(up) - trees.score(x[2000:])) >= -1e-9).all()


def test_quality_on_held_out_documents():
    both = [(a["text"], b["quality"]) for a in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist() for b in [LABELS.get(a["doc_id"])] if b]
    x, y = np.array([quality.statistics(t)[1] for t, _ in both]), np.array([q for _, q in both], float)
    trees = quality.fit(x[::2], y[::2])
    assert ((trees.score(x[1::2]) > 0) == y[1::2]).mean() > 0.95


LABELS = {x["doc_id"]: x for x in pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pylist()}


def test_pii(frame, docs, empty):
    got = by_id(pii.report(frame), *(f"n_{k}" for k in tagger.KINDS), "base_sha256")
    for d, t in docs:
        want = brute.personal(t)
        text = ",".join(f"{k}:{a}:{b}" for k in tagger.KINDS for a, b in want[k])
        assert got[d] == (*(len(want[k]) for k in tagger.KINDS), brute.sha(text))
    assert pii.report(empty).count() == 0


def test_pii_patterns():
    parts = ["a", "b.", "@", "@", "1", "22", "255", ".", ".", "-", " ", "+", "(", ")", "é", "4111111111111111", "0", "x@y.z", "1.2.3.4"]
    for _ in range(5000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 30)))
        assert pii.base(text) == brute.personal(text), text


def test_tagger_learns_and_finds_what_patterns_miss():
    model = tagger.default_model()
    texts, spans = tagger.labelled(300, 77)
    found = tagger.decode(model, texts)
    right = sum(len(set(a) & set(b)) for a, b in zip(found, spans, strict=True))
    assert right / sum(map(len, found)) > 0.85 and right / sum(map(len, spans)) > 0.85
    text = "Please call (017) 555-7713 or write to anna.bo [@] mail.example.com today. " + "la " * 400
    ((known, more),) = pii.spans([text], model)
    assert not any(known.values())
    assert "phone" in {k for k, _, _ in more} and all(pii.holds(k, text[a:b]) for k, a, b in more)


def test_tagger_gradients():
    m = tagger.Model.fresh(4, 1)
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, tagger.CLASSES, (3, 9)), np.array([[0, 1, 2, 2, 0, 3, 4, 0, 0], [5, 6, 0, 0, 7, 8, 8, 0, 1], [0] * 9])
    _, grads = tagger.gradients(m, x, y)
    for p, g in zip(m.parts(), grads, strict=True):
        for _ in range(5):
            i = tuple(rng.integers(0, s) for s in p.shape)
            if p is m.trans and not tagger.may_follow()[i]:
                continue
            p[i] += 1e-5
            up = tagger.gradients(m, x, y)[0]
            p[i] -= 2e-5
            down = tagger.gradients(m, x, y)[0]
            p[i] += 1e-5
            assert (up - down) / 2e-5 == pytest.approx(g[i], rel=1e-3, abs=1e-5)


def test_windows_do_not_change_what_is_found():
    model = tagger.default_model()
    text = "+1 (017) 555-7713 "
    far = "la la la. " * 90
    alone = [(k, a, b) for k, a, b in tagger.decode(model, [far + text + far])[0]]
    both = tagger.decode(model, [far + text + far + text + far])[0]
    assert alone and both[: len(alone)] == alone and len(both) == 2 * len(alone)


def test_bpe(frame, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    theirs = Tokenizer.from_file(path)
    texts = [t or "" for _, t in docs] + ["<|endoftext|>a<|endoftext|> b", "aaaaaaa aaaa", "\x1c\x85 　x\r\n\n y"] + ["".join(r.choice("ab 'és\n中9\U0001f389") for _ in range(40)) for _ in range(200)]
    codec = bpe.codec(path)
    want = [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]
    assert codec.encode_batch(texts) == want
    assert [codec.decode(i) for i in want] == [theirs.decode(i, skip_special_tokens=False) for i in want] == texts
    got = by_id(bpe.digests(frame, path), "n_tokens", "ids_sha256", "decoded_sha256")
    for (d, t), ids in zip(docs, want, strict=False):
        assert got[d] == (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(t or ""))
    assert bpe.digests(empty, path).count() == 0
    codec.ids = {}
    many = bpe.encode(frame.limit(3), path).collect()
    assert all(x["decoded"] == dict(docs)[x["doc_id"]] or dict(docs)[x["doc_id"]] is None for x in many)


def test_chat(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", None), (1, 2, "assistant", "a\\b</s>"), (1, 3, "assistant", "[INST]"), (1, 4, "user", "<|end|>x<|turn|>"), (2, 0, "user", "only"), (3, 0, None, ""), (3, 0, "assistant", "t"), (3, 0, "assistant", "t"), (None, 0, "assistant", "n"), (4, None, "odd\nrole", "z" * 100_000)]
    df = spark.createDataFrame([(*x, 9) for x in rows], "conv_id long, turn long, role string, text string, example int").repartition(3)
    made = chat.examples(df)
    assert made.where("conv_id = 1 and loss_start >= 0").count() == 2
    got = {x["conv_id"]: x for x in chat.read_back(made).collect()}
    order = lambda x: tuple((v is not None, v) for v in x[1:])
    for c in {x[0] for x in rows}:
        turns = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == c), key=order)]
        said = "".join(t for role, t in turns if role == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == brute.sha("".join(f"{role}\n{t}\n" for role, t in turns))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(said), brute.sha(said))
    assert chat.read_back(chat.examples(df.limit(0))).count() == 0


def test_chat_escape():
    parts = ["<s>", "<", "/", "s", ">", "\\", "[INST]", "[", "INST", "]", "</s>", "<|", "|>", "turn", "<|turn|>", "<<SYS>>", "n"]
    for _ in range(5000):
        s = "".join(r.choice(parts) for _ in range(r.randint(0, 9)))
        e = chat.escape(s)
        assert chat.unescape(e) == s and not chat.CONTROL_RE.search(e)


def test_warc(spark, tmp_path):
    fake = "WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "http://a", "same"), (2, "http://b\r\nX: y", "same"), (3, None, None), (4, "u", ""), (5, "u", "x\r\n\r\n" + fake + "tail"), (6, "u", fake * 3), (7, "u", "é" * 5000), (None, "u", "same"), (8, "u", "\r\n\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    warc.write(df, str(tmp_path / "w"), file_bytes=3_000)
    assert len(list((tmp_path / "w").glob("*.gz"))) > 2
    got = {x["page_id"]: x for x in warc.read(spark, str(tmp_path / "w")).collect()}
    assert len(got) == len(rows)
    assert {p: x["record_type"] for p, x in got.items() if x["record_type"] == "revisit"} == {1: "revisit", 3: "revisit"}
    assert got[1]["refers_to"] == 2 and got[3]["refers_to"] == 4 and got[1]["payload_digest"] == got[2]["payload_digest"]
    for p, _, html in rows:
        assert got[p]["payload_bytes"] == len((html or "").encode())
        assert got[p]["payload"] == (html or "") or got[p]["record_type"] == "revisit"
    warc.write(df.limit(0), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


def test_pointer_jumping():
    start = np.array([50, 0, 10, 20, 30, 33])
    after = np.array([60, 10, 30, 99, 50, 50])
    assert warc.reachable(start, after).tolist() == [True, True, True, False, True, False]
    assert warc.reachable(np.array([], np.int64), np.array([], np.int64)).tolist() == []
    n = 1000
    assert warc.reachable(np.arange(n), np.arange(1, n + 1)).all()


def test_archive_of_other_makers():
    body = b"WARC/1.0\r\nwarc-type: response\r\ncontent-length: 5\r\n\r\nhello\r\n\r\n"
    found = list(warc.candidates(body * 2 + body[:20]))
    assert [f[0] for f in found] == [0, len(body)]


@pytest.mark.parametrize("ranges", [1, 7, 1000])
def test_sharding(spark, ranges):
    rows = [(i, "t" * (i % 50), "big" if i % 3 else f"s{i % 5}") for i in range(500)] + [(7, "t", None), (7, "t", None), (None, None, "s1")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, source string, r int").repartition(4)
    got = sharding.interleave(df, bucket_rows=ranges).collect()
    assert len(got) == len(rows)
    held = {}
    for x in got:
        held.setdefault(x["shard"], []).append(x["slot"])
        assert x["law"] == "rows" and x["grown_shard"] is None
    assert set(held) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in held.values())
    assert max(map(len, held.values())) - min(map(len, held.values())) <= 1
    for source in ("big", "s0"):
        total = sum(x["stratum"] == source for x in got)
        for k in held:
            assert abs(sum(x["stratum"] == source and x["shard"] == k for x in got) - total / 8) < 2
    again = sharding.interleave(df.repartition(2), bucket_rows=ranges).collect()
    key = lambda x: (x["shard"], x["slot"], x["doc_id"] or -1, x["size"], x["text_crc32"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert sharding.interleave(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_covers_its_table(spark, name):
    table = "conversations" if name.startswith("op4_") else "documents"
    df = queries.QUERIES[name](spark, SF)
    source = spark.read.parquet(f"{SF}/{table}.parquet")
    n = source.count() if table == "documents" else source.select("conv_id").distinct().count() + 1
    assert df.count() == n
