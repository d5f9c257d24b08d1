"""Removal of repeated byte strings by a distributed difference-cover suffix order."""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import CACHE_BYTES, Tables, counts_before, cut, one_id_a_row, per_row, slices, tidy, trim
from gaugeworks.llm.lines import FILTER_BITS, bits_set, chunked, gathered
from gaugeworks.llm.shingles import mix

#: Length of the strings that are removed if they start elsewhere too.
LENGTH = 400
#: A string's anchor is the least of the hashes of GRAM bytes in its first CHOICE places: LENGTH = GRAM + CHOICE - 1.
GRAM = 136
CHOICE = LENGTH - GRAM + 1
#: Bytes of a block, the symbol of the suffix order; LENGTH is a whole number of them.
BLOCK = 50
WHOLE = LENGTH // BLOCK
DEPTH = WHOLE + 1
LEFT = -(-(CHOICE - 1) // BLOCK)
#: Distinct triples that one window partition ranks, about.
RANGE_TRIPLES = 20_000


#: A value for each byte, and a base whose powers weigh the places of a string, for the hashes that slide over all places.
_R = np.random.default_rng(20_240_229)
VALUE = _R.integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_R.integers(0, 2**62)) * 4 + 3
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    if len(_POWERS["up"]) < n:
        for name, b in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
            p = np.full(max(n, 1 << 20), np.uint64(b % 2**64))
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def digest(s: bytes) -> int:
    """64 bits of a cryptographic digest."""
    return int.from_bytes(hashlib.blake2b(s, digest_size=8).digest(), "little")


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(VALUE[data] * up[: len(data)], out=total[1:])
    return total


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row, from running minima within blocks in both directions."""
    n = len(x)
    full = np.full(-(-n // width) * width + width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Anchors of all strings of LENGTH bytes of the texts: number of the text, first and last start of the strings that
    have it, its place, a hash of its GRAM bytes and a digest of all that its strings cover. Places are within the text.

    Which place of a string is its anchor depends on the string alone, so equal strings have it at the same place.
    """
    none = {k: np.zeros(0, np.int64) for k in ("text", "first", "last", "at")} | {k: np.zeros(0, np.uint64) for k in ("gram", "cover")}
    long = [i for i, t in enumerate(texts) if len(t) >= LENGTH]
    if not long:
        return none
    data = np.frombuffer(b"".join(texts[i] for i in long), np.uint8)
    sizes = np.array([len(texts[i]) for i in long])
    begin = np.cumsum(sizes) - sizes
    total = prefix_sums(data)
    _, down = powers(len(total))
    gram = (total[GRAM:] - total[:-GRAM]) * down[: len(data) - GRAM + 1]
    gram = (gram ^ (gram >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    least = sliding_least((gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64), CHOICE)
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.concatenate([np.arange(b, b + n - LENGTH + 1) for b, n in zip(begin, sizes, strict=True)])
    text = np.repeat(np.arange(len(long)), sizes - LENGTH + 1)
    place = place[starts]
    head = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])])
    tail = np.r_[head[1:], len(place)] - 1
    own, first, last, place = text[head], starts[head], starts[tail], place[head]
    b = begin[own]
    body = data.tobytes()
    cover = np.fromiter((digest(body[x:y]) for x, y in zip(first.tolist(), (last + LENGTH).tolist(), strict=True)), np.uint64, len(first))
    return {"text": np.array(long)[own], "first": first - b, "last": last - b, "at": place - b, "gram": gram[place], "cover": cover}


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def spot_bit(doc: np.ndarray, first: np.ndarray) -> np.ndarray:
    return (mix(doc.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + first.astype(np.uint64) + np.uint64(77)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def gram_bit(gram: np.ndarray) -> np.ndarray:
    return (mix(gram) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def all_anchors(docs: DataFrame) -> DataFrame:
    """(gram, cover, doc, first) of every anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch, "text", CACHE_BYTES):
                a = anchors([(t or "").encode() for t in s.column("text").to_pylist()])
                doc = s.column("id").cast(pa.int64()).take(pa.array(a["text"]))
                yield pa.RecordBatch.from_arrays([signed(a["gram"]), signed(a["cover"]), doc, pa.array(a["first"].astype(np.int32))], names=["gram", "cover", "doc", "first"])
        trim()

    return docs.mapInArrow(run, "gram long, cover long, doc long, first int")


def chosen_anchors(docs: DataFrame, grams: np.ndarray, spots: np.ndarray) -> DataFrame:
    """The anchors whose gram has its bit set; with the text around it, and where in that text it begins, for those whose spot has its bit set."""
    schema = pa.schema([("gram", pa.int64()), ("cover", pa.int64()), ("doc", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("at", pa.int32()), ("zero", pa.int32()), ("near", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch, "text", CACHE_BYTES):
                texts = [(t or "").encode() for t in s.column("text").to_pylist()]
                a = anchors(texts)
                keep = bits_set(grams, gram_bit(a["gram"]))
                a = {k: v[keep] for k, v in a.items()}
                doc = s.column("id").cast(pa.int64()).take(pa.array(a["text"]))
                wanted = bits_set(spots, spot_bit(doc.fill_null(0).to_numpy(zero_copy_only=False), a["first"]))
                left = np.minimum(a["at"], (LEFT + 1) * BLOCK)
                near = [texts[t][p - z : p + DEPTH * BLOCK] if w else None for t, p, z, w in zip(a["text"].tolist(), a["at"].tolist(), left.tolist(), wanted.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([signed(a["gram"]), signed(a["cover"]), doc, *(pa.array(x.astype(np.int32)) for x in (a["first"], a["last"], a["at"], left)), pa.array(near, pa.binary())], schema=schema)
        trim()

    return docs.mapInArrow(run, "gram long, cover long, doc long, first int, last int, at int, zero int, near binary")


def bits_of(df: DataFrame, kind: str) -> np.ndarray:
    """A fixed-size hash filter of grams (gram) or of spots (doc, first)."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield chunked(gram_bit(b.column("gram").to_numpy().view(np.uint64)) if kind == "gram" else spot_bit(b.column("doc").to_numpy(), b.column("first").to_numpy()))

    return gathered(df.mapInArrow(spread, "chunk int, bit int"))


def symbols(near: DataFrame) -> DataFrame:
    """(id, doc, at, zero, sym): the whole blocks around each anchor, as numbers, on a grid that begins at the anchor; ``zero`` is the place of the anchor's own block among them."""

    def f(c: dict[str, list]) -> list:
        out, zeros = [], []
        for text, z in zip(c["near"], c["zero"], strict=True):
            skip, back = z % BLOCK, z // BLOCK
            # 1 to 2^62, so that 0 can stand for the end of a string
            out.append([(digest(text[at : at + BLOCK]) >> 2) + 1 for at in range(skip, len(text) - BLOCK + 1, BLOCK)])
            zeros.append(back)
        return [c["id"], c["doc"], c["at"], zeros, out]

    return per_row(near.select("id", "doc", "at", "zero", "near"), "id long, doc long, at int, zero int, sym array<long>", "near", f)


def named(triples: DataFrame, ranges: int, top: float) -> DataFrame:
    """(x, y, z, name): distinct triples numbered from 1 in the order of x, y, z. Ranges of x are ranked apart, and counts of the ranges before are added."""
    distinct = triples.select("x", "y", "z").distinct().withColumn("part", F.floor(F.col("x") / F.lit(top) * ranges).cast("long"))
    before = counts_before(distinct.groupBy("part").agg(F.count(F.lit(1)).alias("c")), "part", "c").select("part", "before")
    ranked = distinct.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("x", "y", "z")))
    return ranked.join(before, "part").select("x", "y", "z", (F.col("r") + F.col("before")).alias("name"))


def sample_ranks(strings: DataFrame, tables: Tables) -> DataFrame:
    """(id, ranks): for each string an array with the rank of the suffixes at places 1 and 2 modulo 3, to DEPTH symbols at least, and 0 elsewhere.

    Triples of symbols at those places are sorted and named, and the string of names is sorted by triples of names again, so that each
    round orders three times as many symbols. It ends when names tell all suffixes apart, or the strings looked for. Equal ranks mean equal symbols.
    """
    values, top, step = strings.select("id", F.col("sym").alias("v")), float(2**62 + 1), 1
    places = F.filter(F.sequence(F.lit(0), F.size("v") - 1), lambda p: p % 3 != 0)
    while step < DEPTH:
        get = lambda k, step=step: F.coalesce(F.get("v", F.col("p") + k * step), F.lit(0))
        triples = values.where(F.size("v") > 1).select("id", "v", F.explode(places).alias("p")).select("id", "p", F.size("v").alias("n"), get(0).alias("x"), get(1).alias("y"), get(2).alias("z"))
        triples = tables.keep(triples)
        count = triples.count()
        told = triples.join(named(triples, max(1, count // RANGE_TRIPLES), top), ["x", "y", "z"])
        arrays = told.groupBy("id", "n").agg(F.map_from_entries(F.collect_list(F.struct("p", "name"))).alias("m"))
        values = tables.keep(arrays.select("id", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda p: F.coalesce(F.col("m")[p], F.lit(0).cast("long"))).alias("v")))
        most = values.agg(F.max(F.array_max("v"))).first()[0] or 1
        top, step = float(most + 1), 3 * step
        if most == count:
            break
    return values.select("id", F.col("v").alias("ranks"))


def precedes(a: tuple, b: tuple) -> int:
    """Order of two suffixes (place mod 3, symbols, rank here, at the next place and at the one after) of which the first two symbols are equal.

    Two sampled ones compare by rank. One at place 0 modulo 3 has no rank, but its successors have: against place 1 the
    next ones compare, against place 2 those after.
    """
    if a[0] and b[0]:
        x, y = a[2], b[2]
    elif 2 in (a[0], b[0]):
        x, y = a[4], b[4]
    else:
        x, y = a[3], b[3]
    return (x > y) - (x < y)


def shared(a: list[int], b: list[int]) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def merged(strings: DataFrame, ranks: DataFrame) -> DataFrame:
    """(id, back, most, run_id, run_at): for the suffix ``back`` blocks before each anchor, the symbols that it shares with a
    neighbour in the order of all suffixes, and, for those that share WHOLE - 1, the first suffix of their run.

    Suffixes are dealt by their first two symbols; within these, the sampled ones and the rest are merged by the ranks
    that follow, and neighbours' symbols compared. Grids of one document may coincide: suffixes of one place count once.
    """
    back = F.sequence(F.lit(0), F.least(F.col("zero"), F.size("sym") - 1))
    own = strings.join(ranks, "id", "left").select("id", "doc", "at", "zero", "sym", F.coalesce("ranks", F.expr("cast(array() as array<long>)")).alias("ranks"), F.explode(back).alias("back"))
    p = F.col("zero") - F.col("back")
    rank = lambda k: F.coalesce(F.get("ranks", p + k), F.lit(0).cast("long"))
    rows = own.select("id", "back", "doc", (F.col("at") - F.col("back") * BLOCK).alias("begin"), (p % 3).alias("m"), F.slice("sym", p + 1, DEPTH).alias("s"), rank(0).alias("r0"), rank(1).alias("r1"), rank(2).alias("r2"))
    # a suffix shorter than a string without its edges takes part in nothing
    rows = rows.where(F.size("s") >= WHOLE - 1).withColumn("a", F.get("s", 0)).withColumn("b", F.get("s", 1))
    dealt = rows.repartition("a", "b").sortWithinPartitions("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat():
            for batch in batches:
                yield from zip(*(batch.column(n).to_pylist() for n in ("a", "b", "m", "s", "r0", "r1", "r2", "id", "back", "doc", "begin")), strict=True)

        out: list[tuple] = []
        for _, group in itertools.groupby(flat(), key=lambda r: r[:2]):
            places: dict[tuple, list[tuple]] = {}
            for r in group:
                places.setdefault(r[9:], []).append(r[2:9])
            suffixes = [own[0] for own in places.values()]
            if len(suffixes) < 2:
                continue
            twins = {own[0][5:7]: own for own in places.values()}
            suffixes.sort(key=functools.cmp_to_key(precedes))
            with_next = [shared(a[1], b[1]) for a, b in itertools.pairwise(suffixes)]
            start = 0
            for i, s in enumerate(suffixes):
                before, after = with_next[i - 1] if i else 0, with_next[i] if i < len(with_next) else 0
                if before < WHOLE - 1:
                    start = i
                if max(before, after) >= WHOLE - 1:
                    out += [(t[5], t[6], max(before, after), suffixes[start][5], suffixes[start][6]) for t in twins[s[5:7]]]
            if len(out) > 20_000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "back", "most", "run_id", "run_at"])

    return dealt.mapInArrow(run, "id long, back int, most int, run_id long, run_at int")


def by_blocks(near: DataFrame, order: DataFrame) -> DataFrame:
    """(doc, start, end) of strings' starts, end exclusive, that the order alone shows to be repeated: whole blocks of LENGTH bytes on the grid, and all starts between two of them where a block more is shared."""
    places = near.select("id", "doc", "at", "first", "last").join(order, "id")
    begin = F.col("at") - F.col("back") * BLOCK
    end = begin + F.when(F.col("most") >= DEPTH, BLOCK + 1).otherwise(1)
    spans = places.where(F.col("most") >= WHOLE).select("doc", F.greatest(begin, "first").alias("start"), F.least(end, F.col("last") + 1).alias("end"))
    return spans.where("start < end")


def by_edges(near: DataFrame, order: DataFrame) -> DataFrame:
    """(doc, start, end) of the starts between grid places that are repeated though no block more is shared: those that share
    WHOLE - 1 blocks, the bytes before them to the start and the bytes after them to the end. Only runs with an undecided member are looked at."""
    outer = order.select("id", (F.col("back") - 1).alias("back"), (F.col("most") >= DEPTH).alias("done"))
    core = near.select("id", "doc", "at", "first", "last", "zero", "near").join(order, "id").join(outer, ["id", "back"], "left")
    begin = F.col("at") - F.col("back") * BLOCK
    # starts 1 to BLOCK - 1 bytes before the core that are this anchor's and not yet decided
    low, high = F.greatest(begin - (BLOCK - 1), "first"), F.least(begin - 1, "last")
    place = F.col("zero") - F.col("back") * BLOCK
    head_at = F.greatest(place - (BLOCK - 1), F.lit(0))
    rows = core.select(
        "run_id", "run_at", "doc", begin.alias("begin"), low.alias("low"), F.when(F.coalesce("done", F.lit(False)), low - 1).otherwise(high).alias("high"),
        F.substring("near", head_at + 1, place - head_at).alias("head"), F.substring("near", place + (WHOLE - 1) * BLOCK + 1, F.lit(BLOCK - 1)).alias("tail"),
    )
    # the window deals and sorts the runs: after a join by the same columns Spark leaves out a repartition and its sort, and may then broadcast the join or split its parts, so that a run comes in pieces
    undecided = F.max(F.col("low") <= F.col("high")).over(Window.partitionBy("run_id", "run_at"))
    dealt = rows.withColumn("undecided", undecided).where("undecided").drop("undecided")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat():
            for batch in batches:
                yield from zip(*(batch.column(n).to_pylist() for n in ("run_id", "run_at", "doc", "begin", "low", "high", "head", "tail")), strict=True)

        for _, group in itertools.groupby(flat(), key=lambda r: r[:2]):
            members = [r[2:] for r in group]
            out = []
            for k in range(1, BLOCK):
                keys = [(h[-k:], t[: BLOCK - k]) if len(h) >= k and len(t) >= BLOCK - k else None for *_, h, t in members]
                seen = Counter(k for k, _ in {(key, m[:2]) for key, m in zip(keys, members, strict=True)})
                for (doc, begin, low, high, _, _), key in zip(members, keys, strict=True):
                    if key is not None and low <= begin - k <= high and seen[key] > 1:
                        out.append((doc, begin - k, begin - k + 1))
            if out:
                d, s, e = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(s, pa.int32()), pa.array(e, pa.int32())], names=["doc", "start", "end"])

    return dealt.mapInArrow(run, "doc long, start int, end int")


def repeated(docs: DataFrame) -> DataFrame:
    """(id, spans): for each document with repeated strings, the ranges [start, end) of their starts, as array<struct<start, end>>.

    The ids have to differ. 1. Each string of LENGTH bytes has an anchor, the least hash in it. Strings can only be equal if their anchors' grams are, so
    anchors with grams of one place only are done. 2. Anchors whose whole cover (all strings that have it) is found twice, by a cryptographic digest, are
    done too: all their strings are repeated. 3. One anchor of each cover whose gram has several covers goes on, as a
    string of blocks on a grid that begins at the anchor: equal strings lie alike on their grids. A difference cover orders
    the suffixes of these strings: triples at places 1 and 2 modulo 3 are sorted and named, names sorted by triples in turn, the remaining suffixes
    merged, and neighbours' prefixes compared. 4. Starts between grid places are decided from the shared blocks and the bytes at both edges.
    """
    rows = docs.select(F.col("id").cast("long").alias("id"), "text").where("id is not null")
    with Tables(docs.sparkSession) as tables:
        covers = tables.keep(all_anchors(rows).groupBy("gram", "cover").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc", "first")).alias("spot")))
        tidy(docs.sparkSession)
        grams = covers.groupBy("gram").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("k")).where("n > 1")
        covers = tables.keep(covers.join(grams.select("gram", "k"), "gram").select("gram", "cover", "c", "k", F.col("spot.doc").alias("doc"), F.col("spot.first").alias("first")))
        tidy(docs.sparkSession)
        found = tables.keep(chosen_anchors(rows, bits_of(covers, "gram"), bits_of(covers.where("k > 1"), "spot")))
        done = found.join(covers.where("c > 1").select("gram", "cover"), ["gram", "cover"], "left_semi").select("doc", F.col("first").alias("start"), (F.col("last") + 1).alias("end"))
        near = found.where("near is not null").withColumn("id", F.monotonically_increasing_id())
        near = tables.keep(near.select("id", "doc", "first", "last", "at", "zero", "near"))
        strings = tables.keep(symbols(near))
        order = tables.keep(merged(strings, sample_ranks(strings, tables)))
        tidy(docs.sparkSession)
        spans = done.union(by_blocks(near, order)).union(by_edges(near, order))
        return cut(spans.groupBy("doc").agg(F.collect_set(F.struct("start", "end")).alias("spans")).withColumnRenamed("doc", "id"))


def removed_runs(spans: list[tuple[int, int]] | None) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by strings whose starts are in the ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans or []):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b - 1 + LENGTH))
        else:
            out.append((a, b - 1 + LENGTH))
    return out


def apply(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, runs (removed bytes, array<struct<start, end>>) and kept (the remaining bytes) of each document.

    A byte goes if a string of LENGTH bytes that covers it also starts anywhere else, in this document or another; strings are judged on the input.
    Null text: as empty. Texts under LENGTH bytes lose nothing. Ids are integers; rows of one id and different texts are documents of their own,
    rows of one id and one text are the same places; a null id neither loses nor matches anything. Empty input: no rows.
    Other columns are not read.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    with Tables(docs.sparkSession) as tables:
        keyed = one_id_a_row(rows, tables)
        found = repeated(keyed.select(F.col("key").alias("id"), "text")).withColumnRenamed("id", "key")
        names = keyed.select("key", "id", F.xxhash64("text").alias("hash"))
        spans = cut(names.join(found, "key").select("id", "hash", "spans"))
    joined = rows.withColumn("hash", F.xxhash64("text")).join(spans, ["id", "hash"], "left")
    kind = docs.schema[id_column].dataType.simpleString()

    def f(c: dict[str, list]) -> list:
        runs = [removed_runs([(s["start"], s["end"]) for s in x or []]) for x in c["spans"]]
        texts = [(t or "").encode() for t in c["text"]]
        kept = []
        for t, r in zip(texts, runs, strict=True):
            edges = [0, *(x for run in r for x in run), len(t)]
            kept.append(b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        return [c["id"], [len(t) for t in texts], [[{"start": a, "end": b} for a, b in r] for r in runs], kept]

    return per_row(joined, f"`{id_column}` {kind}, n_bytes long, runs array<struct<start: long, end: long>>, kept binary", "text", f)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document, from ``apply``."""
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return apply(docs).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("runs").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
