"""Near-duplicate documents by HyperMinHash sketches."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import CACHE_BYTES, Tables, cut, per_row, tidy, trim
from gaugeworks.llm.components import components
from gaugeworks.llm.shingles import ExactSets, sequence_digest, sets, similar

#: 2^8 buckets; 42 bands of 6 registers lose a pair of similarity 0.8 with a chance of 3 in a million.
BUCKET_BITS, MANTISSA_BITS, ROWS = 8, 10, 6
BUCKETS = 1 << BUCKET_BITS
BANDS = BUCKETS // ROWS
#: Chance that different minima give equal registers, about.
COLLISION = 0.17 / (1 << MANTISSA_BITS)
#: A pair is verified unless its estimate is under the threshold by more than so many standard errors.
ERRORS = 5
#: Set sizes under RATIO^CLASSES are part of the band key, by powers of RATIO.
RATIO, CLASSES = 1.25, 20
#: Under this similarity, bands and size classes would lose pairs.
LEAST_PERCENT = 80
#: Sets of up to so many shingles are similar to equal sets only.
SMALL = 3
#: Bytes of sketches, or of sketches and texts, in a block of the last step, about.
BLOCK_BYTES = 1 << 19
#: Documents for which tables of links have a file, about: files follow the documents, not the session's number of partitions.
FILE_DOCS = 5_000
#: Buckets that an empty one borrows from, in this order.
DONORS = np.random.default_rng(8).integers(0, BUCKETS, (BUCKETS, 64))


def sketch(s: np.ndarray) -> bytes:
    """The size of a sorted set of hashes (4 bytes) and its registers (2 bytes each): for each bucket of the high bits, the leading
    zeros of the least rest and the bits after its first one. The least of a bucket is the first in order. An
    empty bucket takes the register of the first filled one of its donors, so that small sets fill all bands."""
    starts = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)
    at = np.searchsorted(s, starts)
    there = at < np.r_[at[1:], len(s)]
    out = np.zeros(BUCKETS, "<u2")
    value = s[at[there]] << np.uint64(BUCKET_BITS)
    zeros = np.zeros(len(value), np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        low = value < np.uint64(1) << np.uint64(64 - step)
        zeros[low] += step
        value[low] <<= np.uint64(step)
    mantissa = (value << np.uint64(1)) >> np.uint64(64 - MANTISSA_BITS)
    out[there] = (np.minimum(zeros, 62) << MANTISSA_BITS) | mantissa.astype(np.int64)
    if len(empty := np.flatnonzero(~there)):
        full = np.flatnonzero(there)
        usable = there[DONORS[empty]]
        donor = np.where(usable.any(axis=1), DONORS[empty, usable.argmax(axis=1)], full[np.searchsorted(full, empty) % len(full)])
        out[empty] = out[donor]
    return len(s).to_bytes(4, "little") + out.tobytes()


def opened(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and registers of sketches."""
    rows = np.frombuffer(b"".join(blobs), np.dtype([("n", "<u4"), ("r", "<u2", BUCKETS)]))
    return rows["n"], rows["r"]


def likely(same: np.ndarray, n: np.ndarray, share: float) -> np.ndarray:
    """Whether pairs with so many equal registers, and sets of about n, may have a similarity of ``share``, by the estimate less expected collisions."""
    estimate = (same - COLLISION * BUCKETS) / BUCKETS
    return estimate >= share - ERRORS * np.sqrt(share * (1 - share) / np.minimum(BUCKETS, 0.8 * n))


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """(id, n, digest, registers) of each document; the digest is of its words in order. It and registers are null for an empty set."""

    def f(c: dict[str, list]) -> list:
        texts = [(t or "").encode() for t in c["text"]]
        found = sets(texts, k)
        return [c["id"], [len(s) for s in found], [sequence_digest(t) for t in texts], [sketch(s) if len(s) else None for s in found]]

    kind = docs.schema["id"].dataType.simpleString()
    return per_row(docs, f"id {kind}, n long, digest binary, registers binary", "text", f, CACHE_BYTES)


def banded(reps: DataFrame) -> DataFrame:
    """(key, id): a key for each band, whose number is in the last six bits. Small sets meet only sets of about their size, the smallest only those with all registers equal."""
    width = 2 * ROWS
    head = 4
    size_class = F.least(F.lit(CLASSES), F.floor(F.log(F.col("n").cast("double")) / float(np.log(RATIO)) + 1e-9)).cast("int")
    keys = []
    for i in range(BANDS):
        keys.append(F.xxhash64(F.lit(i), "c", F.substring("registers", head + i * width + 1, width)).bitwiseAND(~63).bitwiseOR(i))
    small = reps.where(F.col("n") <= SMALL).select("id", F.xxhash64("registers").bitwiseOR(63).alias("key"))
    sized = reps.where(F.col("n") > SMALL).withColumn("c0", size_class).withColumn("c", F.explode(F.when(F.col("c0") < CLASSES, F.array(F.col("c0"), F.col("c0") + 1)).otherwise(F.array("c0"))))
    return sized.select("id", F.explode(F.array(*keys)).alias("key")).union(small)


def confirmed(pairs: DataFrame, registers: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union, after the estimate has sorted out most others."""
    kind = pairs.schema["a"].dataType.simpleString()

    def estimate(c: dict[str, list]) -> list:
        (n, x), (_, y) = opened(c["ra"]), opened(c["rb"])
        ok = np.flatnonzero(likely((x == y).sum(axis=1), n, percent / 100))
        return [[c["a"][i] for i in ok], [c["b"][i] for i in ok]]

    def verify(c: dict[str, list]) -> list:
        # a leader's pairs follow each other: its text is taken apart once for a run of them
        exact = ExactSets(k)
        own = {t: exact.of((t or "").encode()) for t in dict.fromkeys([*c["ta"], *c["tb"]])}
        out = [(a, b) for a, b, ta, tb in zip(c["a"], c["b"], c["ta"], c["tb"], strict=True) if similar(own[ta], own[tb], percent)]
        return [[p[0] for p in out], [p[1] for p in out]]

    def beside(p: DataFrame, t: DataFrame, column: str, left: str, right: str) -> DataFrame:
        return p.join(t.select(F.col("id").alias("a"), F.col(column).alias(left)), "a").join(t.select(F.col("id").alias("b"), F.col(column).alias(right)), "b")

    found = per_row(beside(pairs, registers, "registers", "ra", "rb"), f"a {kind}, b {kind}", "ra", estimate).distinct()
    return per_row(beside(found, texts, "text", "ta", "tb"), f"a {kind}, b {kind}", "tb", verify).distinct()


def across(members: DataFrame, k: int, percent: int, texts: bool) -> DataFrame:
    """Links (a, b) between members(family, id, label, registers, text) of one family and different labels.

    Members outside a family's largest label ask all of its members, in blocks of both, of BLOCK_BYTES each: a task holds two blocks whatever
    the family's size. Pairs count that share a band and that the estimate lets pass. Without ``texts`` these pairs' ends
    come back as (a, a), so that only members with such a pair need their texts; with ``texts`` full sets of words are compared at once.
    One link to a label is enough for each that asks, so what leaves doesn't grow with the pairs.
    """
    kind = members.schema["id"].dataType.simpleString()
    members = members if texts else members.withColumn("text", F.lit(""))
    members = members.withColumn("weight", F.length("registers") + F.octet_length("text"))
    sizes = members.groupBy("family", "label").agg(F.sum("weight").alias("w"))
    heads = sizes.groupBy("family").agg(F.max(F.struct("w", "label")).alias("m"), F.sum("w").alias("w"))
    heads = heads.select("family", F.col("m.label").alias("largest"), F.ceil(F.col("w") / BLOCK_BYTES).cast("int").alias("mb"), F.greatest(F.ceil((F.col("w") - F.col("m.w")) / BLOCK_BYTES), F.lit(1)).cast("int").alias("qb"))
    rows = members.join(heads, "family").withColumn("asks", F.col("label") != F.col("largest"))
    columns = ["family", "x", "y", "asking", "id", "label", "registers", "text"]
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    own = rows.withColumn("x", spread("qb")).withColumn("y", place("mb")).withColumn("asking", F.lit(False))
    asking = rows.where("asks").withColumn("x", place("qb")).withColumn("y", spread("mb")).withColumn("asking", F.lit(True))
    dealt = own.select(columns).union(asking.select(columns)).repartition("family", "x", "y").sortWithinPartitions("family", "x", "y")

    def compare(group: list[tuple]) -> Iterator[tuple]:
        q, m = [g for g in group if g[3]], [g for g in group if not g[3]]
        if not q or not m:
            return
        code = {x: i for i, x in enumerate({g[5] for g in group})}
        label = np.array([code[g[5]] for g in m])
        (n, r), (_, rq) = opened([g[6] for g in m]), opened([g[6] for g in q])
        exact, known, ends = ExactSets(k), {}, set()

        def full(text: str) -> np.ndarray:
            if text not in known:
                known[text] = exact.of(text.encode())
            return known[text]

        for i, g in enumerate(q):
            same = r == rq[i]
            at = np.flatnonzero(likely(same.sum(axis=1), n, percent / 100) & (label != code[g[5]]))
            at = at[same[at, : BANDS * ROWS].reshape(-1, BANDS, ROWS).all(axis=2).any(axis=1)]
            if not texts:
                ends |= {m[j][4] for j in at.tolist()} | ({g[4]} if len(at) else set())
                continue
            linked = set()
            for j in at.tolist():
                if label[j] not in linked and similar(full(g[7]), full(m[j][7]), percent):
                    linked.add(label[j])
                    yield min(g[4], m[j][4]), max(g[4], m[j][4])
        yield from ((x, x) for x in ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        for _, group in itertools.groupby(flat(), key=lambda g: g[:3]):
            if found := list(compare(list(group))):
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        trim()

    return dealt.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def groups(docs: DataFrame, k: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id linked with it, directly or by others) of each document.

    1. Documents of the same words in the same order are one, named by their least id. 2. Registers of a HyperMinHash sketch are banded, and
    documents that share a band are compared with the least id of the band, unless they are linked already: the estimate from the registers
    comes first, then the full sets, of the words themselves and not of hashes. 3. Bands whose members are then in several components make
    families, and what is outside a family's largest component is compared with all of its members, first by registers alone, then by the
    texts of those that the estimate lets pass. So links within a component aren't all tried, and none between components is missed.
    Components come from alternating stars. Only ids, sketches and links travel; texts do for documents that share a band.

    Null text, empty text or text of white space: an empty set, linked with nothing. Rows with one doc_id are one
    document, linked by any of its texts. A null doc_id is in no component (null). Empty input: no rows. Other columns
    are not read. A ``percent`` under 80 is an error: bands and size classes are made for 80.
    """
    if percent < LEAST_PERCENT:
        raise ValueError(f"percent has to be {LEAST_PERCENT} at least: bands and size classes would lose pairs at {percent}")
    with Tables(docs.sparkSession) as tables:
        return grouped(docs, k, percent, id_column, text_column, tables)


def grouped(docs: DataFrame, k: int, percent: int, id_column: str, text_column: str, tables: Tables) -> DataFrame:
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    known = tables.keep(sketches(rows, k))
    files = max(1, -(-known.count() // FILE_DOCS))
    least = known.where("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("rep"))
    member = known.select("id", "n", "digest").join(least, "digest", "left").select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep"))
    reps = known.join(least.select(F.col("rep").alias("id"), F.col("digest").alias("own")), "id").where("digest = own").select("id", "n", "registers")
    bands = banded(reps)
    shared = bands.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader < last")
    inside = tables.keep(bands.join(shared.select("key", "leader"), "key").select("key", "id", "leader"))
    near = inside.select("id").distinct()
    registers = tables.keep(reps.join(near, "id").select("id", "registers"))
    texts = tables.keep(rows.join(near, "id", "left_semi"))
    tidy(docs.sparkSession)  # here and below: what plans leave would fill the driver's heap step by step

    # first the leader that shares most bands, then those of other bands from which that hasn't linked
    pairs = inside.where("id <> leader").groupBy(F.col("leader").alias("a"), F.col("id").alias("b")).agg(F.count(F.lit(1)).alias("bands"))
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("bands", "a")).alias("a")).select("a", "b")
    # rows of one id are one document, whatever their texts
    own = member.where("rep is not null").groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("id", "a")
    links = cut(confirmed(best, registers, texts, k, percent).union(member.join(own, "id").where("rep <> a").select("a", F.col("rep").alias("b"))), files)
    label = components(links, files)
    side = lambda c: label.select(F.col("id").alias(c), F.col("label").alias(f"label_{c}"))
    apart = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")
    more = cut(confirmed(apart, registers, texts, k, percent), files)
    tidy(docs.sparkSession)
    if not more.isEmpty():
        links = links.union(more)
        label = components(links, files)
    # a leader has met all of its band
    others = inside.where("id <> leader").select("key", "id").join(label, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    split = others.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("key")
    others = cut(others.join(split, "key", "left_semi"), files)
    tidy(docs.sparkSession)
    if not others.isEmpty():
        firsts = others.groupBy("key").agg(F.min("id").alias("a"))
        chained = others.join(firsts, "key").where("id <> a").select("a", F.col("id").alias("b")).distinct()
        family = components(chained, files).select("id", F.col("label").alias("family"))
        members = tables.keep(others.select("id", "label").distinct().join(family, "id").join(registers, "id"))
        tidy(docs.sparkSession)
        ends = across(members, k, percent, False).select(F.col("a").alias("id"))
        left = members.join(ends, "id", "left_semi").join(texts, "id")
        more = cut(across(left.select("family", "id", "label", "registers", F.coalesce("text", F.lit("")).alias("text")), k, percent, True), files)
        tidy(docs.sparkSession)
        if not more.isEmpty():
            label = components(links.union(more), files)
    label = label.select(F.col("id").alias("rep"), "label")
    return cut(member.join(label, "rep", "left").select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("label", "rep").alias("component_id")), files)
