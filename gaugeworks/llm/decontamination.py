"""Benchmark decontamination by Wu-Manber multi-pattern search."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gaugeworks.llm.common import Tables, cut, per_row, schema_of, unpacked, whole_row

#: Maps A-Z to lower case and all other ASCII but 0-9 and a-z to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
WINDOW = 10
#: Bytes of a block; a window's blocks are looked up in the shift table.
BLOCK = 7
#: Windows that one pass over the documents looks for. More are looked for in more passes, a job each.
PASS_WINDOWS = 20_000


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def windows(item: list[bytes], size: int = WINDOW) -> set[bytes]:
    """Windows of an item, each with a space at either end and between words; a shorter item is one window."""
    if not item:
        return set()
    return {b" " + b" ".join(item[i : i + size]) + b" " for i in range(max(1, len(item) - size + 1))}


@dataclass
class Matcher:
    """Shift table and suffix buckets for windows of at least ``least`` bytes."""

    least: int
    block: int
    shift: dict[bytes, int] = field(default_factory=dict)
    bucket: dict[bytes, list[bytes]] = field(default_factory=dict)

    @staticmethod
    def of(patterns: list[bytes]) -> Matcher:
        least = min(map(len, patterns))
        block = min(BLOCK, least)
        m = Matcher(least, block)
        last = least - block
        for p in patterns:
            for i in range(last):
                b = p[i : i + block]
                if last - i < m.shift.get(b, last + 1):
                    m.shift[b] = last - i
            end = p[last:least]
            m.shift[end] = 0
            m.bucket.setdefault(end, []).append(p)
        return m

    def find(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        """Every place at which a window stands, and the window.

        ``at`` is where the current block begins. A block that no window has within its first
        ``least`` bytes allows the longest shift; one that ends those bytes selects the
        windows that are compared there, and the search goes on one byte later.
        """
        get, block, longest = self.shift.get, self.block, self.least - self.block + 1
        back, at, end = self.least - self.block, self.least - self.block, len(text) - self.block
        while at <= end:
            b = text[at : at + block]
            step = get(b, longest)
            if step:
                at += step
                continue
            for p in self.bucket[b]:
                if text.startswith(p, at - back):
                    yield at - back, p
            at += 1


class Search:
    """Windows of benchmark items, by length: one short window must not shorten the shifts of the others."""

    def __init__(self, owned: list[tuple[str, bytes]]):
        self.owners: dict[bytes, set[str]] = {}
        for item, w in owned:
            self.owners.setdefault(w, set()).add(item)
        groups: dict[int, list[bytes]] = {}
        for p in self.owners:
            groups.setdefault(0 if len(p) < 12 else 1 if len(p) < 32 else 2, []).append(p)
        self.matchers = [Matcher.of(g) for g in groups.values()]

    def hits(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Words of the text, runs [start, end) of hit words, and the items found."""
        w = words(text)
        if not w:
            return 0, [], []
        body = b" " + b" ".join(w) + b" "
        found = sorted((at, p) for m in self.matchers for at, p in m.find(body))
        runs: list[tuple[int, int]] = []
        items: set = set()
        seen, word = 0, 0
        for at, p in found:
            word += body.count(b" ", seen, at)
            seen = at
            start, end = word, word + p.count(b" ") - 1
            if runs and start <= runs[-1][1]:
                runs[-1] = (runs[-1][0], max(runs[-1][1], end))
            else:
                runs.append((start, end))
            items |= self.owners[p]
        return len(w), runs, sorted(items)


def passes(benchmark: DataFrame) -> Iterator[list[tuple[str, bytes]]]:
    """(item, window) of the whole benchmark, PASS_WINDOWS at a time; an item may go on in the next pass. One empty pass for an empty benchmark."""
    held: list[tuple[str, bytes]] = []
    none = True
    for r in benchmark.select("item_id", "text").toLocalIterator():
        for w in windows(words(r["text"])):
            held.append((str(r["item_id"]), w))
            if len(held) == PASS_WINDOWS:
                yield held
                held, none = [], False
    if held or none:
        yield held


HITS = "n long, runs array<struct<s: long, e: long>>, items array<string>"


def with_hits(docs: DataFrame, *names: str) -> StructType:
    """The columns of ``docs`` of these names, and those of HITS."""
    return StructType([docs.schema[n] for n in names] + schema_of(HITS).fields)


def searched(docs: DataFrame, search: Search) -> DataFrame:
    """(row, place, text, n, runs, items) for docs(row, text, place): the words, runs of hit words and items found by one pass."""

    def f(c: dict[str, list]) -> list:
        found = [search.hits(t) for t in c["text"]]
        return [c["row"], c["place"], c["text"], [n for n, _, _ in found], [[{"s": s, "e": e} for s, e in r] for _, r, _ in found], [i for _, _, i in found]]

    return per_row(docs, with_hits(docs, "row", "place", "text"), "text", f)


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs' columns with ``gw_words`` (count), ``gw_runs`` (array of struct<s, e>: hit words) and ``gw_items`` (ids as strings, sorted).

    A pass holds at most PASS_WINDOWS windows, whatever the size of the benchmark or of an item. A benchmark that needs one pass
    is one step over the documents, which aren't shuffled. A larger one is searched for in a job for each pass, which writes only what it hits, by doc_id and
    hash of the text; these are put together and joined to the documents in the end.

    Null text or text without words: nothing hit. Equal items are all reported. An empty benchmark hits nothing. A null item_id counts as 'None'.
    Repeated rows and ids are searched each by itself; columns of any name pass through, but for these three, which are replaced.
    """
    names = [c for c in docs.columns if c not in ("gw_words", "gw_runs", "gw_items")]
    place = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    # the text travels once, beside the other columns
    packed = docs.select(whole_row([c for c in names if c != "text"]).alias("row"), F.col("text").cast("string").alias("text"), place.alias("place"))
    blocks = passes(benchmark)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        out = searched(packed, Search(first))
    else:
        with Tables(docs.sparkSession) as tables:
            bare = packed.select(F.struct(F.lit(0)).alias("row"), "text", "place")
            hits = [tables.keep(searched(bare, Search(b)).where(F.size("runs") > 0).select("place", "runs", "items").distinct()) for b in itertools.chain([first, second], blocks)]
            every = functools.reduce(DataFrame.union, hits)
            every = every.groupBy("place").agg(F.flatten(F.collect_list("runs")).alias("old"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("known"))
            out = cut(joined(searched(packed, Search([])), every))
    return out.select(*unpacked(names, text=F.col("text")), F.col("n").alias("gw_words"), F.col("runs").alias("gw_runs"), F.array_sort("items").alias("gw_items"))


def joined(counted: DataFrame, every: DataFrame) -> DataFrame:
    """``counted`` with the runs, put together, and the items that all passes have found."""
    both = counted.select("row", "place", "n", "text").join(every, "place", "left")

    def f(c: dict[str, list]) -> list:
        runs = [[{"s": s, "e": e} for s, e in merged([(r["s"], r["e"]) for r in old or []])] for old in c["old"]]
        return [c["row"], c["text"], c["n"], runs, [k or [] for k in c["known"]]]

    return per_row(both, with_hits(both, "row", "text"), "text", f)


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each document, from ``find``."""
    found = find(docs.select("doc_id", "text"), benchmark)
    n_hit = F.aggregate("gw_runs", F.lit(0).cast("long"), lambda a, r: a + r["e"] - r["s"])
    return found.select(
        "doc_id",
        F.col("gw_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("gw_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("gw_items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
