"""Proportional stratified interleaving into shards of equal row counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import counts_before

#: Hexadecimal digits of MD5 that order a stratum: 2^52 steps are exact in a double.
HASH_DIGITS = 13
#: Rows that one window partition ranks, about.
BUCKET_ROWS = 2_000


def interleave(
    df: DataFrame,
    shards: int = 8,
    seed: int = 7,
    id_column: str = "doc_id",
    text_column: str = "text",
    stratum_column: str = "source",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Deals rows to ``shards`` so that each shard has the mixture of ``stratum_column``.

    Rows of a stratum are ranked in the order of a seeded hash. All rows are then
    ordered by fractional rank, (rank + 1/2) / rows of the stratum, and that order
    is cut into ``shards`` runs whose lengths differ by one at most (law ``rows``).

    Neither ranking gathers a stratum in one task: a stratum is first split by ranges
    of its hash, and the fractional ranks by ranges of (0, 1); a rank is the rank within
    a range plus the count of the ranges before, summed in two levels. Ranges hold about ``bucket_rows`` rows at any size,
    so a stratum with a third of all rows makes more ranges, not longer ones.

    Returns id_column, stratum, size (UTF-8 bytes plus 1), text_crc32, law, shard,
    slot (from 0 within the shard) and grown_shard (null under this law).

    Null text: no bytes, size 1, crc32 0. Null stratum: a stratum of its own. Ties and repeated rows:
    ordered by id, size and checksum; equal rows get distinct slots. Null ids come first.
    Empty input: no rows. Other columns are not read.
    """
    body = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    rows = df.select(
        F.col(id_column).alias("id"),
        F.coalesce(F.concat(F.lit("="), F.col(stratum_column).cast("string")), F.lit("")).alias("stratum"),
        (F.length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("crc"),
    )
    n = df.count()
    ranges = max(1, -(-n // bucket_rows))
    seeded = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))
    rows = rows.withColumn("h", F.conv(F.substring(seeded, 1, HASH_DIGITS), 16, 10).cast("long"))
    rows = rows.withColumn("range", F.floor(F.col("h") / F.lit(float(16**HASH_DIGITS)) * ranges))

    by_range = rows.groupBy("stratum", "range").agg(F.count(F.lit(1)).alias("c"))
    totals = by_range.groupBy("stratum").agg(F.sum("c").alias("total"))
    by_range = counts_before(by_range, "range", "c", ("stratum",)).join(totals, "stratum").select("stratum", "range", "before", "total")
    own = Window.partitionBy("stratum", "range").orderBy("h", "id", "size", "crc")
    ranked = rows.withColumn("r", F.row_number().over(own) - 1).join(by_range, ["stratum", "range"])
    ranked = ranked.withColumn("fraction", (F.lit(2) * (F.col("r") + F.col("before")) + 1) / (F.lit(2) * F.col("total")))
    ranked = ranked.select("id", "stratum", "size", "crc", "h", "fraction", F.floor(F.col("fraction") * ranges).alias("part"))

    by_part = ranked.groupBy("part").agg(F.count(F.lit(1)).alias("c"))
    parts = counts_before(by_part, "part", "c").select("part", F.col("before").alias("start"))
    within = Window.partitionBy("part").orderBy("fraction", "stratum", "h", "id", "size", "crc")
    placed = ranked.withColumn("k", F.row_number().over(within) - 1).join(parts, "part").withColumn("at", F.col("start") + F.col("k"))
    whole = max(n, 1)
    shard = F.expr(f"(at * {shards}L) div {whole}L")
    return placed.select(
        F.col("id").alias(id_column),
        F.expr("substr(stratum, 2)").alias("stratum"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        shard.cast("int").alias("shard"),
        (F.col("at") - F.expr(f"(({shard_start(shards, whole)}))")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def shard_start(shards: int, whole: int) -> str:
    """SQL for the position at which the shard of position ``at`` begins."""
    return f"((at * {shards}L) div {whole}L * {whole}L + {shards - 1}L) div {shards}L"
