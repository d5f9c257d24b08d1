"""Connected components of links, by stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import cut, tidy, trim

#: Links in a file of a round, about: files follow the links, not the session's number of partitions. Also links that a task joins at once, at most about.
FILE_LINKS = 1 << 18


def roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least number linked with each of 0 to n - 1, directly or by others, by links between ``u`` and ``v``."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def joined(edges: DataFrame) -> DataFrame:
    """Links (u, v) of the same components as ``edges``, where those of a task, FILE_LINKS at a time, are one star for each of their components, at its least id.
    No id has more links than before by it, and a task holds a bounded number of them."""

    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        links = pa.Table.from_batches(held).combine_chunks()
        u, v = (links.column(c).combine_chunks() for c in ("u", "v"))
        ids = pa.concat_arrays([u, v]).unique()
        ids = ids.take(pa.compute.sort_indices(ids))
        root = roots(*(pa.compute.index_in(x, value_set=ids).to_numpy() for x in (u, v)), len(ids))
        own = np.flatnonzero(root != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(own)), ids.take(pa.array(root[own]))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= FILE_LINKS:
                yield star(held)
                held.clear()
        if held:
            yield star(held)
        trim()

    return edges.mapInArrow(run, edges.schema)


def components(links: DataFrame, files: int | None = None) -> DataFrame:
    """(id, label) of each id in links(a, b): label is the least id that it can be reached from, itself included.

    Large and small stars alternate: each id's neighbours are linked to the least of them, until every link
    leads to the least id of its component. Before the first round and after each, a task joins the links that it has, so that rounds, each of which is
    several shuffles, are only for components that lie in several tasks. Rounds grow with the logarithm of a component's diameter. Minima are
    aggregated before they are joined back, so an id with very many links is no one task's work. The first round has ``files`` files at most.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), files)
    if n := edges.count():
        edges = cut(joined(edges.coalesce(-(-n // FILE_LINKS))))
        tidy(links.sparkSession)
    while n:
        # done when every id has one link, and to an id that has none
        ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("k"), F.lit(0).alias("to")).union(edges.select("v", F.lit(0), F.lit(1)))
        each = ends.groupBy("id").agg(F.sum("k").alias("k"), F.max("to").alias("to"))
        n, tangled = each.agg(F.sum("k"), F.max((F.col("k") > 1) | ((F.col("k") > 0) & (F.col("to") > 0)))).first()
        if not tangled:
            break
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        edges = cut(joined(small.coalesce(-(-n // FILE_LINKS))))
        tidy(links.sparkSession)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("label")).union(edges.select("v", "v").distinct())
