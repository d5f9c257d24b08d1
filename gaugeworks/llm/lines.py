"""Line deduplication by an exact set-similarity join."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import CACHE_BYTES, Tables, cut, one_id_a_row, per_row, slices, tidy, trim, unpacked, whole_row
from gaugeworks.llm.shingles import FOLD, hashed_words, mix

#: Counters of token frequency: a fixed number, shared by hash, so that what is broadcast doesn't grow with the vocabulary.
COUNTER_BITS = 23
RANGE_BITS = 16
#: Bits of the fixed-size hash filter of places.
FILTER_BITS = 26
CHUNK_BITS = 16
#: Earlier candidates of a line that one token may give in the first round. Lines that have more, and no match among these, get a second round without a limit.
FIRST_CANDIDATES = 4
#: Lines of the second round, and bytes of their texts, that every task may hold; more are dealt by token, as in the first round.
SECOND_LINES, SECOND_BYTES = 20_000, 4 << 20
#: Bytes of postings in a part, about, and parts that a task reads.
PART_BYTES, TASK_PARTS = 2 << 20, 16
#: Tokens that occur more often are dealt by line length as well.
HOT_COUNT = 50_000
#: Postings of a token from which pairs are found in blocks, not step by step with other tokens'.
MANY = 512
#: Postings of a token and a length class from which equal stretches of parity bits are tried, if so few others have one in common.
STRETCH_FROM, STRETCH_GAIN = 1 << 14, 100
#: Pairs of postings in a block, about, its rows at least, and pairs that are held against each other at once: so few that they stay in a core's cache.
BLOCK_PAIRS, BLOCK_ROWS, TILE_ROWS, TILE_PAIRS = 1 << 20, 256, 128, 1 << 17
#: Lines that a task remembers, so as not to deal them again.
REMEMBERED = 1 << 17
FLUSH_BYTES = 4 << 20
MOST_N = 65_535
POSTING = np.dtype([("t", "<u4"), ("line", "<u4"), ("doc", "<i8"), ("b0", "<u8"), ("b1", "<u8"), ("key", "<u8"), ("n", "<u2"), ("p", "<u2")])
PAIR = "x_doc long, x_line int, y_doc long, y_line int, more boolean"


def words_by_line(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, the number of its line over all texts, and the number of lines of each text."""
    body = b"\n".join(texts)
    h, _, start, _ = hashed_words([body])
    breaks = np.cumsum(np.frombuffer(body, np.uint8) == 10)
    per_text = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
    return h, breaks[start] if len(start) else start, per_text


KEY_BYTES = 16
NO_KEY = bytes(KEY_BYTES)
#: A line's place by its key, and the bits of a key that name the part that it is dealt in.
KEYED = np.dtype([("k0", "<u8"), ("k1", "<u8"), ("doc", "<i8"), ("line", "<u4")])
KEY_PART_BITS = 12


#: As FOLD, but for the ends of lines.
FOLD_IN_LINES = bytes(10 if b == 10 else f for b, f in enumerate(FOLD))


def line_keys(text: bytes) -> list[bytes]:
    """For each line of ``text`` a cryptographic digest of its words in order, zeros for a line without words."""
    out = []
    for x in text.translate(FOLD_IN_LINES).split(b"\n"):
        if b"  " in x or x[:1] == b" " or x[-1:] == b" ":
            x = b" ".join(x.split())
        out.append(hashlib.blake2b(x, digest_size=KEY_BYTES).digest() if x else NO_KEY)
    return out


def line_marks(h: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each line with words: its number, and 128 bits of its words' hashes in order. They only spare a line that is dealt already."""
    if not len(h):
        return np.zeros(0, np.int64), np.zeros((0, 2), np.uint64)
    first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    place = (np.arange(len(h)) - np.repeat(first, np.diff(np.r_[first, len(h)]))).astype(np.uint64)
    a = np.add.reduceat(mix(h + place * np.uint64(0x9E3779B97F4A7C15)), first)
    b = np.add.reduceat(mix((h ^ np.uint64(0xD6E8FEB86659FD93)) + place * np.uint64(0xC2B2AE3D27D4EB4F)), first)
    return line[first], np.stack([a, b], axis=1)


def frequency_code(count: np.ndarray) -> np.ndarray:
    """0 for a count of 1 or less, and twice the logarithm of larger ones, up to 63."""
    return np.minimum(np.log2(np.maximum(count, 1)) * 2, 63).astype(np.uint8)


def bucket_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def place_bit(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    return (mix(doc.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + line.astype(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def token_bit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def parted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """KEYED ``rows`` in the order of their keys: the first place of each key, and the others."""
    k0 = np.ascontiguousarray(rows["k0"])
    order = np.argsort(k0)
    same = k0[order[1:]] == k0[order[:-1]]
    if same.any():
        twice = np.r_[False, same] | np.r_[same, False]
        own = rows[order[twice]]
        order[twice] = order[twice][np.lexsort((own["line"], own["doc"], own["k1"], own["k0"]))]
    rows = rows[order]
    again = np.zeros(len(rows), bool)
    again[1:] = same & (rows["k1"][1:] == rows["k1"][:-1])
    return rows[~again], rows[again]


def keys_and_counts(docs: DataFrame) -> DataFrame:
    """Of rows(id, own, text_hash, text): rows (doc_id, own, text_hash, n_lines), with the number of lines with words; rows (part, keys), KEYED places of these lines
    dealt by key, or in part -1 such as have an earlier one of their key in the same flush; and rows (bucket, counts) of token counts by range of counters."""
    schema = pa.schema([("doc_id", pa.int64()), ("own", pa.int64()), ("text_hash", pa.int64()), ("n_lines", pa.int64()), ("part", pa.int32()), ("keys", pa.binary()), ("bucket", pa.int32()), ("counts", pa.binary())])

    def told(n: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

    def dealt(held: list[np.ndarray]) -> pa.RecordBatch:
        first, again = parted(np.concatenate(held))
        part = (first["k0"] >> np.uint64(64 - KEY_PART_BITS)).astype(np.int32)
        edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, int)
        blobs = [again.tobytes(), *(first[a:b].tobytes() for a, b in itertools.pairwise(edge))]
        return told(len(blobs), part=pa.array(np.r_[-1, part[edge[:-1]]].astype(np.int32)), keys=pa.array(blobs, pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTER_BITS, np.uint32)
        held: list[np.ndarray] = []
        for batch in batches:
            for part in slices(batch, "text", CACHE_BYTES):
                texts = [(t or "").encode() for t in part.column("text").to_pylist()]
                np.add.at(total, bucket_of(hashed_words(texts)[0]), np.uint32(1))
                keys = [line_keys(t) for t in texts]
                n, ids = np.array([len(k) for k in keys]), part.column("id").cast(pa.int64())
                rows = np.zeros(n.sum(), KEYED)
                rows["k0"], rows["k1"] = np.frombuffer(b"".join(itertools.chain.from_iterable(keys)), "<u8").reshape(-1, 2).T
                rows["doc"], rows["line"] = np.repeat(ids.to_numpy(), n), np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
                held.append(rows[(rows["k0"] != 0) | (rows["k1"] != 0)])
                yield told(len(texts), doc_id=ids, own=part.column("own"), text_hash=part.column("text_hash"), n_lines=pa.array([len(k) - k.count(NO_KEY) for k in keys], pa.int64()))
                if sum(r.nbytes for r in held) > FLUSH_BYTES:
                    yield dealt(held)
                    held.clear()
        if held:
            yield dealt(held)
        at = np.flatnonzero(total)
        if len(at):
            cut_at = np.flatnonzero(np.r_[True, np.diff(at >> RANGE_BITS) > 0, True])
            rows = [(int(at[a]) >> RANGE_BITS, np.stack([at[a:b] & ((1 << RANGE_BITS) - 1), total[at[a:b]]]).astype("<u4").tobytes()) for a, b in zip(cut_at[:-1], cut_at[1:], strict=True) if a < len(at)]
            yield told(len(rows), bucket=pa.array([r[0] for r in rows], pa.int32()), counts=pa.array([r[1] for r in rows], pa.binary()))
        del total
        trim()

    return docs.mapInArrow(run, "doc_id long, own long, text_hash long, n_lines long, part int, keys binary, bucket int, counts binary")


def repeats(counted: DataFrame) -> DataFrame:
    """(doc, line) of every line but the first of its class, by key. A flush deals a key once, so that a very common line is no one task's work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(b.column("part").to_pylist(), b.column("keys").to_pylist(), strict=True))
        for part, group in itertools.groupby(rows, key=lambda r: r[0]):
            # those of part -1 are in the result as they are, a blob at a time
            for blobs in ([g[1]] for g in group) if part < 0 else [[g[1] for g in group]]:
                found = np.concatenate([np.frombuffer(b, KEYED) for b in blobs])
                found = found if part < 0 else parted(found)[1]
                yield pa.RecordBatch.from_arrays([pa.array(found["doc"]), pa.array(found["line"].astype(np.int32))], names=["doc", "line"])
        trim()

    places = counted.select("part", "keys")
    dealt = places.where("part >= 0").repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(run, "doc long, line int").union(places.where("part < 0").mapInArrow(run, "doc long, line int"))


def frequencies(counted: DataFrame) -> tuple[np.ndarray, int]:
    """A code of frequency for each counter, and the number of tokens. A byte for each counter comes to the driver, whatever the corpus."""

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(1 << RANGE_BITS, np.int64)
        for blob in t.column("counts").to_pylist():
            at, c = np.frombuffer(blob, "<u4").reshape(2, -1)
            np.add.at(total, at, c)
        return pa.table({"bucket": t.column("bucket").slice(0, 1), "codes": [frequency_code(total).tobytes()], "n": [int(total.sum())]})

    rows = counted.where("bucket is not null").select("bucket", "counts").groupBy("bucket").applyInArrow(add, "bucket int, codes binary, n long").collect()
    codes = np.zeros(1 << COUNTER_BITS, np.uint8)
    for r in rows:
        codes[r["bucket"] << RANGE_BITS : (r["bucket"] + 1) << RANGE_BITS] = np.frombuffer(r["codes"], np.uint8)
    return codes, sum(r["n"] for r in rows)


def by_rarity(h: np.ndarray, line: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens of each line, rarest first, with their line and code: the same order everywhere, by code, then by hash."""
    code = codes[bucket_of(h)]
    packed = (line.astype(np.uint64) << np.uint64(37)) | (code.astype(np.uint64) << np.uint64(31)) | (h >> np.uint64(33))
    order = np.argsort(packed)
    tied = packed[order]
    h2 = h[order]
    if (same := tied[1:] == tied[:-1]).any() and (h2[1:][same] != h2[:-1][same]).any():
        order = np.lexsort((h, code, line))
        h2 = h[order]
    line2 = line[order]
    keep = np.r_[True, (h2[1:] != h2[:-1]) | (line2[1:] != line2[:-1])][: len(h2)]
    return h2[keep], line2[keep], code[order][keep]


def postings(docs: DataFrame, codes: np.ndarray, parts: int, percent: int, tokens: np.ndarray | None = None) -> DataFrame:
    """Rows (part, postings): the prefix of each line's tokens, for lines that the task hasn't had at an earlier place.

    A token that the counters have once can meet no other line and is left out; with ``tokens``, so are those without a bit there.
    """
    hot = int(frequency_code(np.array([HOT_COUNT]))[0])
    grow = np.log(100 / percent)

    def of(part: pa.RecordBatch, had: dict[bytes, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        texts = [(t or "").encode() for t in part.column("text").to_pylist()]
        ids = part.column("id").cast(pa.int64()).to_pylist()
        h, line, per_text = words_by_line(texts)
        if tokens is not None and len(h):
            # whole lines, of which a token is wanted
            begin = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
            wanted = np.repeat(np.logical_or.reduceat(bits_set(tokens, token_bit(h)), begin), np.diff(np.r_[begin, len(h)]))
            h, line = h[wanted], line[wanted]
        if not len(h):
            return np.zeros(0, np.int64), np.zeros(0, POSTING)
        at, marks = line_marks(h, line)
        ends = np.cumsum(per_text)
        text_of = np.searchsorted(ends, at, side="right")
        fresh = np.zeros(len(at), bool)
        number = (at - (ends - per_text)[text_of]).tolist()
        blob = marks.tobytes()
        for i, (t, no) in enumerate(zip(text_of.tolist(), number, strict=True)):
            k = blob[16 * i : 16 * i + 16]
            if (doc := ids[t]) is not None and ((was := had.get(k)) is None or (doc, no) < was):
                had[k] = (doc, no)
                fresh[i] = True
        if len(had) > REMEMBERED:
            had.clear()
        token, own, code = by_rarity(h, np.searchsorted(at, line), codes)
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        n = np.diff(np.r_[first, len(own)])
        bit = (token >> np.uint64(3)) % np.uint64(128)
        one = np.uint64(1) << (bit & np.uint64(63))
        b0 = np.bitwise_xor.reduceat(np.where(bit < 64, one, np.uint64(0)), first)
        b1 = np.bitwise_xor.reduceat(np.where(bit >= 64, one, np.uint64(0)), first)
        place = np.arange(len(own)) - np.repeat(first, n)
        use = fresh[own] & (place < prefix_of(n, percent)[own]) & (code > 0)
        if tokens is not None:
            use &= bits_set(tokens, token_bit(token))
        token, own, code, place = token[use], own[use], code[use], place[use]
        out = np.zeros(len(token), POSTING)
        out["line"], out["doc"] = np.array(number)[own], np.array([i if i is not None else 0 for i in ids], np.int64)[text_of[own]]
        out["b0"], out["b1"], out["key"] = b0[own], b1[own], marks[own, 0]
        out["n"], out["p"] = np.minimum(n[own], MOST_N), np.minimum(place, MOST_N)
        # a frequent token's lines are dealt by length class, each to its own and the next, so that similar lengths meet
        size = np.where(code >= hot, np.floor(np.log(n[own]) / grow + 1e-9), -1).astype(np.int64)
        again = np.flatnonzero(size >= 0)
        out, token, size = np.r_[out, out[again]], np.r_[token, token[again]], np.r_[size, size[again] + 1]
        mixed = mix(token + (size + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        out["t"] = mixed & np.uint64(0xFFFFFFFF)
        return ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int64), out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        had: dict[bytes, tuple[int, int]] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            part, post = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(part, kind="stable")
            part, post = part[order], post[order]
            edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, int)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(part[edge[:-1]], pa.int32()), pa.array([post[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())], names=["part", "postings"])

        for batch in batches:
            for s in slices(batch, "text", CACHE_BYTES):
                held.append(of(s, had))
                if sum(p.nbytes for _, p in held) > FLUSH_BYTES:
                    yield flush()
        if held:
            yield flush()
        trim()

    return docs.mapInArrow(run, "part int, postings binary")


class Posted:
    """Postings of tokens of several lines, as arrays by column, sorted by token and length; of lines of the same words in the same order, dealt by several tasks, the first stands for all."""

    def __init__(self, post: np.ndarray, percent: int):
        t, key, n = (np.ascontiguousarray(post[name]) for name in ("t", "key", "n"))
        both = (t.astype(np.uint64) << np.uint64(32)) | (key >> np.uint64(32))
        order = np.argsort(both)
        same = both[order[1:]] == both[order[:-1]]
        if same.any():
            twice = np.r_[False, same] | np.r_[same, False]
            own = order[twice]
            own = own[np.lexsort((post["line"][own], post["doc"][own], key[own], t[own]))]
            order = np.r_[order[~twice], own[np.r_[True, (t[own[1:]] != t[own[:-1]]) | (key[own[1:]] != key[own[:-1]])]]]
        order = order[np.argsort((t[order].astype(np.uint64) << np.uint64(16)) | n[order])]
        # a token of one line has no pairs
        alike = t[order[1:]] == t[order[:-1]]
        post = post[order[np.r_[False, alike] | np.r_[alike, False]]] if len(order) > 1 else post[:0]
        self.t, self.doc, self.line, self.b0, self.b1 = (np.ascontiguousarray(post[x]) for x in ("t", "doc", "line", "b0", "b1"))
        self.n, self.p, self.percent = post["n"].astype(np.int64), post["p"].astype(np.int64), percent
        #: Order of places: equal places don't meet, as a line has a token once.
        self.place = np.empty(len(post), np.int64)
        self.place[np.lexsort((self.line, self.doc))] = np.arange(len(post))

    def __len__(self) -> int:
        return len(self.t)

    def fits(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which pairs pass the filters of length, position and parity bits; lengths past MOST_N pass."""
        nx, ny = self.n[x], self.n[y]
        both = nx + ny
        least = -(-self.percent * both // (100 + self.percent))
        long = np.maximum(nx, ny)
        some = np.flatnonzero(((100 * (both - long) >= self.percent * long) & (np.minimum(nx - self.p[x], ny - self.p[y]) >= least)) | (long == MOST_N))
        x, y = x[some], y[some]
        apart = np.bitwise_count(self.b0[x] ^ self.b0[y]).astype(np.int64) + np.bitwise_count(self.b1[x] ^ self.b1[y])
        return some[(apart <= (both - 2 * least)[some]) | (long[some] == MOST_N)]


def stretches(n: int, percent: int) -> list[tuple[int, int]]:
    """The parity bits cut into parts [start, end), of which similar lines of up to ``n`` tokens have one in common: one more than
    the bits by which they may differ. One empty part where so many may differ that the bits tell nothing."""
    parts = 2 * n * (100 - percent) // (100 + percent) + 1
    edges = [128 * i // parts for i in range(parts + 1)]
    return [(0, 0)] if n >= MOST_N or parts > 128 else list(itertools.pairwise(edges))


def stretch_code(b0: np.ndarray, b1: np.ndarray, start: int, end: int) -> np.ndarray:
    """A number of the bits [start, end) of each pair of words."""
    low = (b0 >> np.uint64(start)) << np.uint64(64 - (min(end, 64) - start)) if start < 64 and end > start else np.zeros_like(b0)
    if start == 0 and end >= 64:
        low = b0
    first = max(start, 64) - 64
    high = (b1 >> np.uint64(first)) << np.uint64(min(64 - (end - 64 - first), 63)) if end > 64 else np.zeros_like(b1)
    if first == 0 and end == 128:
        high = b1
    return mix(low) + high


def pairs_of_a_few(c: Posted, of: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (earlier, later) that fit, the later one ``wanted``, among the postings ``of``, in their order of token and length: each with those after it, as far as these aren't too long.

    The shorter line of a pair has the token among so few that as many others follow as both need. Most pairs end at half of
    their parity bits, held against what the longest partner allows.
    """
    t, n, p, b0 = c.t[of].astype(np.int64), c.n[of], c.p[of], c.b0[of]
    longest = 100 * n // c.percent
    width = np.searchsorted((t << 17) | n, (t << 17) | longest, side="right") - np.arange(len(of)) - 1
    width[(p * (100 + c.percent) > n * (100 - c.percent)) & (n < MOST_N)] = 0
    order = np.argsort(-width, kind="stable")
    order = order[: np.count_nonzero(width)]
    width, bits = width[order], b0[order]
    allowed = np.where(longest >= MOST_N, 64, (n + longest) * (100 - c.percent) // (100 + c.percent))[order]
    for k in range(1, int(width[0]) + 1 if len(width) else 0):
        m = np.searchsorted(-width, -k, side="right")
        near = np.flatnonzero(np.bitwise_count(bits[:m] ^ b0[order[:m] + k]) <= allowed[:m])
        x, y = of[order[near]], of[order[near] + k]
        x, y = np.where(c.place[x] < c.place[y], x, y), np.where(c.place[x] < c.place[y], y, x)
        still = wanted[y]
        x, y = x[still], y[still]
        fit = c.fits(x, y)
        yield x[fit], y[fit]


def pairs_in_blocks(c: Posted, of: np.ndarray, rows: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (earlier, later) that fit, the later one ``wanted``, of postings of one token in the order of their length: those at ``rows`` with all after them.

    Half of the parity bits of a block of pairs are held against each other at once. A pair of which no side is wanted is in no block, so that
    a group of near copies, most of which soon have partners enough, takes no more than a look at each block.
    """
    n, b0 = c.n[of], c.b0[of]
    longest = 100 * n // c.percent
    end = np.searchsorted(n, longest, side="right")
    allowed = np.where(longest >= MOST_N, 64, (n + longest) * (100 - c.percent) // (100 + c.percent)).astype(np.uint8)
    rows = rows[(end[rows] - rows > 1) & ((c.p[of[rows]] * (100 + c.percent) <= n[rows] * (100 - c.percent)) | (n[rows] >= MOST_N))]
    at = 0
    while at < len(rows):
        still = wanted[of]
        first = int(rows[at])
        columns = np.flatnonzero(still[first:]) + first
        # as many rows as make a block: all with the wanted columns, the wanted ones with the others too
        asking = int(np.searchsorted(columns, end[first]))
        ahead = rows[at : at + (1 << 16)]
        cost = np.cumsum(np.where(still[ahead], int(end[first]) - first, asking + 1))
        block = ahead[: max(BLOCK_ROWS, int(np.searchsorted(cost, BLOCK_PAIRS, side="right")))]
        at += len(block)
        last = int(end[block[-1]])
        others = np.flatnonzero(~still[first:last]) + first
        for r, k in ((block, columns[: np.searchsorted(columns, last)]), (block[still[block]], others)):
            if not len(r) or not len(k):
                continue
            height = max(TILE_ROWS, TILE_PAIRS // len(k))
            width = TILE_PAIRS // TILE_ROWS
            for some, others_of in ((r[a : a + height], k[b : b + width]) for a in range(0, len(r), height) for b in range(0, len(k), width)):
                near = np.bitwise_count(b0[some][:, None] ^ b0[others_of]) <= allowed[some][:, None]
                if not near.any():
                    continue
                i, j = np.divmod(np.flatnonzero(near), len(others_of))
                i, j = some[i], others_of[j]
                inside = (i < j) & (j < end[i])
                x, y = of[i[inside]], of[j[inside]]
                x, y = np.where(c.place[x] < c.place[y], x, y), np.where(c.place[x] < c.place[y], y, x)
                asked = wanted[y]
                x, y = x[asked], y[asked]
                fit = c.fits(x, y)
                yield x[fit], y[fit]


def pairs_of_many(c: Posted, of: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (earlier, later) that fit, the later one ``wanted``, among many postings of one token, the shorter line's length class at a time.

    Similar lines of such lengths differ in few parity bits, so that these, cut into a stretch more than that, agree in one. Where many lines
    have one class and a stretch parts them well, only postings with an equal stretch are compared, in the order of their places, and a later
    line that is not ``wanted`` any more looks no further. Other classes go in blocks.
    """
    size = np.floor(np.log(c.n[of]) / np.log(100 / c.percent) + 1e-9).astype(np.int64)
    by_stretch = []
    for least in np.unique(size).tolist():
        own = of[(size == least) | (size == least + 1)]
        parts = stretches(int(c.n[own].max()), c.percent)
        if len(own) >= STRETCH_FROM and STRETCH_GAIN * len(parts) <= 1 << min(end - start for start, end in parts):
            by_stretch.append((least, parts))
    yield from pairs_in_blocks(c, of, np.flatnonzero(~np.isin(size, [least for least, _ in by_stretch])), wanted)
    for least, parts in by_stretch:
        inside = (size == least) | (size == least + 1)
        own, sizes = of[inside], size[inside]
        by_place = np.argsort(c.place[own])
        own, sizes = own[by_place], sizes[by_place]
        earlier: list[np.ndarray] = []
        for start, end in parts:
            code = stretch_code(c.b0[own], c.b1[own], start, end)
            order = np.argsort(code, kind="stable")
            sorted_code = code[order]
            at, k = np.flatnonzero(wanted[own[order]]), 0
            while len(at):
                k += 1
                at = at[at >= k]
                at = at[(sorted_code[at] == sorted_code[at - k]) & wanted[own[order[at]]]]
                x, y = order[at - k], order[at]
                # each pair in the first stretch that it shares, and in the class of its shorter line
                new = np.minimum(sizes[x], sizes[y]) == least
                for e in earlier:
                    new &= e[x] != e[y]
                x, y = own[x[new]], own[y[new]]
                fit = c.fits(x, y)
                yield x[fit], y[fit]
            earlier.append(code)


def meet(post: np.ndarray, percent: int, limit: int | None, only: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (doc, line) of earlier and later lines, as rows of two arrays, that share a prefix token and pass the filters of length, position and
    parity bits; and of later lines that have more than ``limit`` such partners. With ``only``, later lines are those whose place's bit is set."""
    c = Posted(post, percent)
    if not len(c):
        return (np.zeros((2, 0), np.int64),) * 3
    asked = np.ones(len(c), bool) if only is None else bits_set(only, place_bit(c.doc, c.line))
    edge = np.flatnonzero(np.r_[True, c.t[1:] != c.t[:-1], True])
    runs = np.diff(edge)
    # tokens that nobody asks about have no pairs
    some = np.add.reduceat(asked, edge[:-1]) > 0
    count = np.zeros(len(c), np.int64)
    full = np.zeros(len(c), bool)
    left, right = [], []

    def take(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> None:
        for x, y in pairs:
            if limit is not None and len(y):
                order = np.argsort(y, kind="stable")
                x, y = x[order], y[order]
                edges = np.flatnonzero(np.r_[True, y[1:] != y[:-1], True])
                each = np.diff(edges)
                before = np.repeat(count[y[edges[:-1]]] - edges[:-1], each) + np.arange(len(y))
                count[y[edges[:-1]]] += each
                over = before >= limit
                full[y[over]] = True
                asked[y[over]] = False
                x, y = x[~over], y[~over]
            left.append(x)
            right.append(y)

    take(pairs_of_a_few(c, np.flatnonzero(np.repeat(some & (runs < MANY), runs)), asked))
    for g in np.flatnonzero(some & (runs >= MANY)).tolist():
        take(pairs_of_many(c, np.arange(edge[g], edge[g + 1]), asked))
    x, y = (np.concatenate(s) if s else np.zeros(0, np.int64) for s in (left, right))
    return tuple(np.stack([c.doc[i], c.line[i].astype(np.int64)]) for i in (x, y, np.flatnonzero(full)))


def once(rows: np.ndarray) -> np.ndarray:
    """The columns of ``rows`` that differ."""
    order = np.lexsort(rows)
    rows = rows[:, order]
    return rows[:, np.r_[True, (rows[:, 1:] != rows[:, :-1]).any(axis=0)][: rows.shape[1]]]


def candidates(docs: DataFrame, codes: np.ndarray, parts: int, percent: int, limit: int | None, only: np.ndarray | None = None, tokens: np.ndarray | None = None) -> DataFrame:
    """PAIR rows: places of lines to compare, earlier first; rows with ``more`` name a later line that had more partners than the limit."""

    def of(blobs: list[bytes]) -> pa.RecordBatch:
        x, y, more = meet(np.concatenate([np.frombuffer(b, POSTING) for b in blobs]), percent, limit, only)
        kept, extra = once(np.concatenate([x, y])), once(np.concatenate([more, more]))
        cols = np.concatenate([kept, extra], axis=1)
        flag = np.arange(cols.shape[1]) >= kept.shape[1]
        return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1].astype(np.int32)), pa.array(cols[2]), pa.array(cols[3].astype(np.int32)), pa.array(flag)], names=["x_doc", "x_line", "y_doc", "y_line", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(b.column("part").to_pylist(), b.column("postings").to_pylist(), strict=True))
        for _, group in itertools.groupby(rows, key=lambda r: r[0]):
            yield of([blob for _, blob in group])
        trim()

    # a task has TASK_PARTS parts of PART_BYTES, however many lines there are
    tasks = -(-parts // TASK_PARTS)
    dealt = postings(docs, codes, parts, percent, tokens).repartitionById(tasks, (F.col("part") % tasks).cast("int"))
    return dealt.sortWithinPartitions("part").mapInArrow(run, PAIR)


def bits_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def gathered(positions: DataFrame) -> np.ndarray:
    """A fixed-size array of bits, those at the positions (chunk, bit) set."""

    def pack(t: pa.Table) -> pa.Table:
        bits = np.zeros(1 << CHUNK_BITS, bool)
        bits[t.column("bit").to_numpy()] = True
        return pa.table({"chunk": t.column("chunk").slice(0, 1), "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    step = 1 << (CHUNK_BITS - 3)
    for r in positions.distinct().groupBy("chunk").applyInArrow(pack, "chunk int, bits binary").collect():
        out[r["chunk"] * step : (r["chunk"] + 1) * step] = np.frombuffer(r["bits"], np.uint8)
    return out


def chunked(at: np.ndarray) -> pa.RecordBatch:
    at = np.unique(at)
    return pa.RecordBatch.from_arrays([pa.array((at >> CHUNK_BITS).astype(np.int32)), pa.array((at & ((1 << CHUNK_BITS) - 1)).astype(np.int32))], names=["chunk", "bit"])


def filter_of(places: DataFrame) -> np.ndarray:
    """A hash filter of places (doc, line): a place in it has its bit set; others seldom have."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield chunked(place_bit(b.column("doc").to_numpy(), b.column("line").to_numpy()) if b.num_rows else np.zeros(0, np.int64))

    return gathered(places.mapInArrow(spread, "chunk int, bit int"))


def prefix_of(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of a line's ``n`` tokens, rarest first, a similar line has one of."""
    return n - -(-percent * n // 100) + 1


def prefixes(texts: list[bytes], codes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The prefix tokens of lines, with their line's number and their place, and the number of tokens of each line."""
    h, line, _, _ = hashed_words(texts)
    token, own, _ = by_rarity(h, line, codes)
    n = np.bincount(own, minlength=len(texts))
    place = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    use = place < prefix_of(n, percent)[own]
    return token[use], own[use], place[use], n


def tokens_of(texts: DataFrame, codes: np.ndarray, percent: int) -> np.ndarray:
    """A hash filter of the prefix tokens of lines (doc, line, text)."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield chunked(token_bit(prefixes([t.encode() for t in b.column("text").to_pylist()], codes, percent)[0] if b.num_rows else np.zeros(0, np.uint64)))

    return gathered(texts.mapInArrow(spread, "chunk int, bit int"))


def searched(docs: DataFrame, lines: list[tuple[int, int, str]], codes: np.ndarray, percent: int) -> DataFrame:
    """(doc, line) of those of ``lines`` (doc, line, text) that an earlier line is similar to. One pass over the texts: each
    task holds the lines by prefix token, and those of its own that share one, and fit in length and position, are compared on words."""
    token, own, place, size = prefixes([t.encode() for _, _, t in lines], codes, percent)
    by_token = np.argsort(token, kind="stable")
    token, own, place = token[by_token], own[by_token], place[by_token]
    filled = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    np.bitwise_or.at(filled, token_bit(token) >> 3, np.uint8(1) << (token_bit(token) & 7).astype(np.uint8))
    # few bits: they travel as numbers
    at_bits = np.flatnonzero(filled)
    bytes_there = filled[at_bits]
    y_doc, y_line = (np.array([x[i] for x in lines], np.int64) for i in (0, 1))
    del filled

    def pairs(texts: list[bytes], ids: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of a text, that of a line in it, and that of a later one of ``lines``, for each pair to compare."""
        none = (np.zeros(0, np.int64),) * 3
        h, line, per_text = words_by_line(texts)
        if not len(h):
            return none
        begin = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
        wanted = np.repeat(np.logical_or.reduceat(bits_set(tokens, token_bit(h)), begin), np.diff(np.r_[begin, len(h)]))
        if not wanted.any():
            return none
        h, line = h[wanted], line[wanted]
        at = np.unique(line)
        ends = np.cumsum(per_text)
        text_of = np.searchsorted(ends, at, side="right")
        number = at - (ends - per_text)[text_of]
        t, x, _ = by_rarity(h, np.searchsorted(at, line), codes)
        n = np.bincount(x, minlength=len(at))
        p = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
        use = np.flatnonzero((p < prefix_of(n, percent)[x]) & bits_set(tokens, token_bit(t)))
        t, x, p = t[use], x[use], p[use]
        first = np.searchsorted(token, t)
        each = np.searchsorted(token, t, side="right") - first
        k = np.repeat(first - (np.cumsum(each) - each), each) + np.arange(each.sum())
        x, p = np.repeat(x, each), np.repeat(p, each)
        y, nx, ny, doc = own[k], n[x], size[own[k]], ids[text_of[x]]
        least = -(-percent * (nx + ny) // (100 + percent))
        fit = (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)) & (np.minimum(nx - p, ny - place[k]) >= least)
        fit &= (doc < y_doc[y]) | ((doc == y_doc[y]) & (number[x] < y_line[y]))
        x, y = once(np.stack([x[fit], y[fit]]))
        return text_of[x], number[x], y

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        tokens[at_bits] = bytes_there
        words: dict[int, set[bytes]] = {}
        found: set[int] = set()
        for batch in batches:
            for part in slices(batch.filter(pa.compute.is_valid(batch.column("id"))), "text", CACHE_BYTES):
                texts = [(t or "").encode() for t in part.column("text").to_pylist()]
                mine, of = {}, (-1, [])
                for t, no, y in zip(*(c.tolist() for c in pairs(texts, part.column("id").cast(pa.int64()).to_numpy(), tokens)), strict=True):
                    if y in found:
                        continue
                    if (t, no) not in mine:
                        of = of if of[0] == t else (t, texts[t].split(b"\n"))
                        mine[t, no] = word_set(of[1][no])
                    if y not in words:
                        words[y] = word_set(lines[y][2].encode())
                    if alike(mine[t, no], words[y], percent):
                        found.add(y)
        hits = np.array(sorted(found), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(y_doc[hits]), pa.array(y_line[hits].astype(np.int32))], names=["doc", "line"])
        trim()

    return docs.mapInArrow(run, "doc long, line int").distinct()


def fetched(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(doc, line, text) of the lines whose place's bit is set."""

    def f(c: dict[str, list]) -> list:
        ids, nos, texts = [], [], []
        texts_in = [t or "" for t in c["text"]]
        sizes = np.array([t.count("\n") + 1 for t in texts_in])
        doc = np.repeat(np.arange(len(texts_in)), sizes)
        no = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        known = np.array([i is not None for i in c["id"]])
        whole = np.array([i or 0 for i in c["id"]], np.int64)
        hits = np.flatnonzero(bits_set(bits, place_bit(whole[doc], no)) & known[doc])
        own, own_lines = -1, []
        for d, k in zip(doc[hits].tolist(), no[hits].tolist(), strict=True):
            if d != own:
                own, own_lines = d, texts_in[d].split("\n")
            ids.append(c["id"][d])
            nos.append(k)
            texts.append(own_lines[k])
        return [ids, nos, texts]

    return per_row(docs, "doc long, line int, text string", "text", f)


def word_set(line: bytes) -> set[bytes]:
    return set(line.translate(FOLD).split())


def alike(x: set[bytes], y: set[bytes], percent: int) -> bool:
    """Whether two sets have 100 * intersection >= percent * union."""
    both = len(x & y)
    return 100 * both >= percent * (len(x) + len(y) - both)


def similar(a: str, b: str, percent: int) -> bool:
    """Whether the word sets of two lines have 100 * intersection >= percent * union."""
    return alike(word_set(a.encode()), word_set(b.encode()), percent)


def both_ends(pairs: DataFrame) -> DataFrame:
    """Places (doc, line) of both lines of each pair."""
    return pairs.select(F.col("x_doc").alias("doc"), F.col("x_line").alias("line")).union(pairs.select("y_doc", "y_line")).distinct()


def matched(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(doc, line) of the later line of each pair whose texts are similar; texts(doc, line, text) has both."""
    sides = pairs.join(texts.toDF("x_doc", "x_line", "x"), ["x_doc", "x_line"]).join(texts.toDF("y_doc", "y_line", "y"), ["y_doc", "y_line"])

    def f(c: dict[str, list]) -> list:
        hit = [i for i, (a, b) in enumerate(zip(c["x"], c["y"], strict=True)) if similar(a, b, percent)]
        return [[c["y_doc"][i] for i in hit], [c["y_line"][i] for i in hit]]

    return per_row(sides.select("y_doc", "y_line", "x", "y"), "doc long, line int", "y", f).distinct()


def duplicates(docs: DataFrame, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, text_hash, n_lines (lines with a word), n_removed and removed (their numbers from 0, ascending) of each document with a line.

    A line is a set of words: white space apart, A-Z in lower case. It is removed if a line at an earlier place, by (id, line number),
    has 100 * intersection >= percent * union with it, whether that line stays or not. Lines without words stay.

    1. Lines of the same words in the same order, by a cryptographic digest, are one class, at its first place. 2. Tokens are ordered by frequency codes; a line's
    prefix of rarest tokens is dealt by token. 3. Lines that share a prefix token are candidates if length, position and parity bits
    allow the similarity; the first line of a class in a part stands for it, and among many lines of a token only those with an
    equal stretch of parity bits are looked at, which similar ones have. 4. The texts of candidates are fetched and their words compared. A line with more candidates than the first round takes, and no
    match among those, has all of them compared in a second round, so nothing is lost: in one pass over the texts, or dealt by token if such lines are many. What is broadcast has a fixed size: frequency codes and filters of places.

    Ids are integers. Null text: as empty. Null id: its lines neither match nor are removed, and it has no row here.
    Rows of one id are documents of their own, in the order of xxhash64 of the text (text_hash); rows of one id and one text are one.
    Empty input: no rows. Lines of any length are compared whole. Other columns are not read.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    with Tables(docs.sparkSession) as tables:
        keyed = one_id_a_row(rows, tables)
        found = flagged(keyed.select(F.col("key").alias("id"), F.col("id").alias("own"), F.xxhash64("text").alias("text_hash"), "text"), percent, tables)
        return cut(found.withColumnRenamed("own", id_column))


def flagged(rows: DataFrame, percent: int, tables: Tables) -> DataFrame:
    """(own, text_hash, n_lines, n_removed, removed) of rows(id, own, text_hash, text) whose ids differ."""
    spark = rows.sparkSession
    counted = tables.keep(keys_and_counts(rows))
    rows = rows.select("id", "text")
    codes, tokens = frequencies(counted)
    parts = max(96, -(-int(tokens * 0.2 * POSTING.itemsize) // PART_BYTES))
    # all but the first line of a class go, whatever becomes of that
    again = tables.keep(repeats(counted))
    tidy(spark)
    found = tables.keep(candidates(rows, codes, parts, percent, FIRST_CANDIDATES).distinct())
    tidy(spark)
    first_pairs = found.where("not more").drop("more")
    # rows with ``more`` name their line as both ends, so that its text is fetched too
    texts_of = tables.keep(fetched(rows, filter_of(both_ends(found))))
    hit = cut(matched(first_pairs, texts_of, percent))
    left = found.where("more").select(F.col("y_doc").alias("doc"), F.col("y_line").alias("line")).distinct().join(hit, ["doc", "line"], "left_anti")
    left = tables.keep(left.join(again, ["doc", "line"], "left_anti").join(texts_of, ["doc", "line"]))
    tidy(spark)
    n, size = left.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if n > SECOND_LINES or size > SECOND_BYTES:
        more = tables.keep(candidates(rows, codes, parts, percent, None, filter_of(left), tokens_of(left, codes, percent)).distinct())
        rest = more.drop("more").join(first_pairs, ["x_doc", "x_line", "y_doc", "y_line"], "left_anti")
        hit = cut(hit.union(matched(rest, fetched(rows, filter_of(both_ends(rest))), percent)).distinct())
        tidy(spark)
    elif n:
        hit = cut(hit.union(searched(rows, [tuple(r) for r in left.collect()], codes, percent)).distinct())
    gone = again.union(hit).groupBy("doc").agg(F.array_sort(F.collect_set("line")).alias("removed"))
    told = counted.where("n_lines > 0").join(gone, F.col("doc_id") == F.col("doc"), "left")
    removed = F.coalesce("removed", F.expr("cast(array() as array<int>)"))
    return told.select("own", "text_hash", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def report(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_lines, n_removed and removed of every row; documents without words, and null ids, have no lines."""
    found = duplicates(docs, percent)
    rows = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    joined = rows.join(found, ["doc_id", "text_hash"], "left")
    return joined.select("doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.array_join(F.coalesce("removed", F.expr("cast(array() as array<int>)")), ",").alias("removed"))


def without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the removed lines taken out of their text; a document that had words and has none left goes.

    ``found`` is what ``duplicates`` says of the same rows. Null ids and null texts stay as they are; columns of any name pass through.
    """
    gone = found.select("doc_id", "text_hash", "removed", (F.col("n_lines") == F.col("n_removed")).alias("all")).where("n_removed > 0")
    gone = gone.select(F.struct("doc_id", "text_hash").alias("place"), "removed", "all")
    packed = docs.select(whole_row(docs.columns).alias("row"), F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash")).alias("place"))
    joined = packed.join(gone, "place", "left").where(~F.coalesce("all", F.lit(False))).select("row", F.col("row.text").cast("string").alias("text"), F.coalesce("removed", F.expr("cast(array() as array<int>)")).alias("removed"))
    # the lines are bound once, and the numbers of those that stay come from one set
    kept = F.expr("element_at(transform(array(split(text, '\\n', -1)), own -> array_join(transform(array_except(sequence(0, size(own) - 1), removed), i -> own[i]), '\\n')), 1)")
    text = F.when(F.size("removed") > 0, kept).otherwise(F.col("text"))
    return joined.select(*unpacked(docs.columns, text=text))
