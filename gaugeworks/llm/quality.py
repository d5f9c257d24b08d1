"""Quality rules: counts that fail a document outright, and boosted trees over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from gaugeworks.llm.common import per_row

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Fixed odd factors of the window hash.
FACTORS = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) ^ 0xD6E8FEB86659FD93 << i) & (2**64 - 1) | 1 for i in range(WINDOW)], np.uint64)
MOST_LABELLED = 20_000

#: Statistics that the trees see, and the sign in which quality may move with each (0: free).
FEATURES = {
    "log_words": 0,
    "mean_word": 0,
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "distinct_share": 0,
    "digit_share": 0,
    "upper_share": -1,
    "punctuation_share": 0,
    "longest_word": 0,
    "mean_line": 0,
    "short_line_share": 0,
    "end_mark_share": 0,
    "top_word_share": 0,
    "alpha_word_share": 0,
}
MONOTONE = np.array(list(FEATURES.values()))


def repeated_words(words: list[bytes]) -> int:
    """Words inside a window of 8 words that the text has twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    if len(number) == len(words):
        return 0
    h = sum(ids[i : i + n] * FACTORS[i] for i in range(WINDOW))
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: str) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text, and its features."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    counts = (n, word_chars, symbols, dup, repeat)
    if not n:
        return counts, [0.0] * len(FEATURES)
    b = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    size, k = max(word_chars, 1), len(lines)
    lengths = [len(x) for x in lines]
    features = [
        np.log1p(n),
        size / n,
        symbols / size,
        dup / k,
        repeat / n,
        len(seen) / n,
        b[48:58].sum() / size,
        b[65:91].sum() / size,
        (b[[33, 44, 46, 58, 59, 63]].sum()) / size,
        max(map(len, seen)),
        sum(lengths) / k,
        sum(x < 30 for x in lengths) / k,
        sum(x.rstrip()[-1:] in b".!?" for x in lines) / k,
        max(seen.values()) / n,
        sum(c for w, c in seen.items() if w[:1].isalpha() or w[:1] >= b"\x80") / n,
    ]
    return counts, [float(x) for x in features]


@dataclass(frozen=True)
class Trees:
    """Trees flattened to node arrays; a leaf leads to itself. ``cut`` is the least score that keeps a document."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float
    cut: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of good quality for each row of features: all rows go down all trees together."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 1.0, ridge: float = 1.0) -> Trees:
    """Boosts histogram trees on the logistic loss.

    A split on a feature with a sign is taken only if its leaves' values are in that order, and
    bounds handed down keep later leaves on their side of the middle, so the score is monotone in that feature as a whole.
    """
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(k) * bins
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    total = np.full(n, base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node(v: float) -> int:
        i = len(feature)
        feature.append(0)
        threshold.append(np.inf)
        left.append(i)
        right.append(i)
        value.append(v)
        return i

    def weight(g, h, low, high):
        return np.clip(-g / (h + ridge), low, high)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        root = node(0.0)
        roots.append(root)
        work = [(root, np.arange(n), 0, -np.inf, np.inf)]
        while work:
            i, rows, level, low, high = work.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            value[i] = float(rate * weight(gs, hs, low, high))
            total_of = np.array([], bool)
            if level < depth and len(rows) > 1:
                cells = flat[rows].ravel()
                gl = np.bincount(cells, np.repeat(g[rows], k), k * bins).reshape(k, bins).cumsum(axis=1)
                hl = np.bincount(cells, np.repeat(h[rows], k), k * bins).reshape(k, bins).cumsum(axis=1)
                gr, hr = gs - gl, hs - hl
                wl, wr = weight(gl, hl, low, high), weight(gr, hr, low, high)
                gain = -(gl * wl + (hl + ridge) * wl**2 / 2) - (gr * wr + (hr + ridge) * wr**2 / 2)
                gain = gain + gs * (w := weight(gs, hs, low, high)) + (hs + ridge) * w**2 / 2
                bad = (hl < least) | (hr < least) | (MONOTONE[:k, None] * (wr - wl) < 0)
                gain[bad] = -np.inf
                j, b = divmod(int(gain.argmax()), bins)
                total_of = binned[rows, j] <= b if gain[j, b] > 1e-6 and b < len(edges[j]) else total_of
            if not len(total_of):
                total[rows] += value[i]
                continue
            middle = (wl[j, b] + wr[j, b]) / 2
            low_l = high_r = None
            bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[int(MONOTONE[j])]
            feature[i], threshold[i] = j, float(edges[j][b])
            for side, part, (a, z) in ((left, rows[total_of], bounds[0]), (right, rows[~total_of], bounds[1])):
                side[i] = node(0.0)
                work.append((side[i], part, level + 1, a, z))
            value[i] = 0.0
    arrays = [np.array(a) for a in (feature, threshold, left, right, value, roots)]
    return Trees(*arrays, depth=depth, base=base, cut=0.0)


def with_cut(trees: Trees, x: np.ndarray, y: np.ndarray, lost: float) -> Trees:
    """The trees with a cut under which at most ``lost`` of the good documents of (x, y) lie, and never above even odds."""
    good = np.sort(trees.score(x[y == 1]))
    cut = min(0.0, float(good[int(lost * len(good))])) if len(good) else -np.inf
    return Trees(**(trees.__dict__ | {"cut": cut}))


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, lost: float = 0.005) -> Trees | None:
    """Trees fitted on at most ``most`` labelled documents (the first in the order of a hash of doc_id), or None without both classes.

    A fifth of them are held out to set the cut. ``most`` bounds what comes to the driver: it holds statistics, not texts.
    """
    marked = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("id"), F.col("quality").alias("y"))
    chosen = marked.withColumn("o", F.xxhash64("id")).orderBy("o", "id", "y").limit(most)
    rows = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(chosen), "id").select("id", "o", "y", "text")

    def f(c: dict[str, list]) -> list:
        return [c["id"], c["o"], c["y"], [statistics(t or "")[1] for t in c["text"]]]

    schema = f"id {docs.schema['doc_id'].dataType.simpleString()}, o long, y int, x array<double>"
    found = per_row(rows, schema, "text", f).orderBy("o", "id", "y", "x").limit(most).select("o", "y", "x").collect()
    x = np.array([r["x"] for r in found])
    y = np.array([r["y"] for r in found], float)
    if len(y) < 20 or len(set(y)) < 2:
        return None
    held = np.arange(len(y)) % 5 == 4
    trees = fit(x[~held], y[~held])
    return with_cut(trees, x[held], y[held], lost)


def judge(docs: DataFrame, trees: Trees | None, keep_row: bool = False) -> DataFrame:
    """doc_id, the five counts, base_failed, score and kept of each document; reads doc_id and text. With ``keep_row``: the rows of docs and gw_kept.

    Rejected are texts with fewer than 20 words, texts of which over 30 % lies in repeated windows, and those whose score is under the cut.
    Null and empty texts have no words and fail. Each row is judged by itself, so repeated rows and ids get
    equal verdicts; an empty table gives no rows; other columns are not read. Whole texts are counted, of any length.
    Without trees (no labels of both classes) only the counts decide and the score is null.
    """

    docs = docs.drop("gw_kept") if keep_row else docs
    names = docs.columns

    def f(c: dict[str, list]) -> list:
        both = [statistics(t or "") for t in c["text"]]
        n, chars, symbols, dup, repeat = (list(x) for x in zip(*(b[0] for b in both), strict=True))
        failed = [a < 20 or 100 * r > 30 * a for a, r in zip(n, repeat, strict=True)]
        score = trees.score(np.array([b[1] for b in both])) if trees else None
        good = [True] * len(n) if trees is None else (score >= trees.cut).tolist()
        if keep_row:
            return [*(c[x] for x in names), [g and not x for g, x in zip(good, failed, strict=True)]]
        return [c["id"], n, chars, symbols, dup, repeat, failed, [None] * len(n) if trees is None else score.tolist(), [g and not x for g, x in zip(good, failed, strict=True)]]

    if keep_row:
        return per_row(docs, StructType([*docs.schema.fields, StructField("gw_kept", BooleanType())]), "text", f)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"
    return per_row(docs.selectExpr("doc_id as id", "text"), schema, "text", f)
