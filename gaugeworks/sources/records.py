"""Response caches and scored rows as JSON lines, and the scoring between them."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions import text
from gaugeworks.schemas import RESPONSE, SCORED


def read_cache(spark: SparkSession, *paths: str) -> DataFrame:
    """All records of response caches, duplicates too; blank and malformed lines, such as a line cut off by a crash, are skipped."""
    return spark.read.schema(RESPONSE).option("mode", "DROPMALFORMED").json(list(paths)).where(F.col("cache_key").isNotNull())


def index(records: DataFrame) -> DataFrame:
    """(cache_key, status): the last record of each key, by ``seq`` where the rows have it, else by time."""
    order = F.col("seq") if "seq" in records.columns else F.struct("ts", "status")
    return records.groupBy("cache_key").agg(F.max_by("status", order).alias("status"))


def append(records: DataFrame, path: str) -> None:
    """Adds files of records; a file is there whole or not at all."""
    records.write.mode("append").option("ignoreNullFields", "false").json(path)


def read_scored(spark: SparkSession, *paths: str) -> DataFrame:
    """Scored rows of all files, in their fixed schema; a malformed line is an error. ``seq`` keeps the order of the arguments, then of files and of lines in them."""
    def one(i: int, path: str) -> DataFrame:
        rows = spark.read.schema(SCORED).option("mode", "FAILFAST").json(path)
        block = F.coalesce(F.col("_metadata.file_block_start"), F.lit(0))
        return rows.withColumn("seq", F.struct(F.lit(i).alias("argument"), F.col("_metadata.file_path").alias("file"), block.alias("block"), F.monotonically_increasing_id().alias("line")))

    return functools.reduce(DataFrame.union, [one(i, p) for i, p in enumerate(paths)])


def write_scored(rows: DataFrame, path: str) -> None:
    rows.select(*[f.name for f in SCORED]).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def score(records: DataFrame, questions: DataFrame) -> DataFrame:
    """Scored rows of records: the record's letters and gold count before the question's, whose option texts it lacks.

    Failed calls are invalid, with the method provider_error.
    """
    options = questions.select("question_id", "option_texts", F.col("letters").alias("q_letters"), F.col("gold_letter").alias("q_gold"))
    r = records.join(options, "question_id", "left")
    letters = F.coalesce("letters", "q_letters", F.expr("cast(array() as array<string>)"))
    gold = F.coalesce(F.nullif("gold_letter", F.lit("")), F.col("q_gold"))
    ok = F.col("status") == "success"
    x = text.extracted(F.col("response_text"), letters, F.coalesce("option_texts", F.expr("cast(array() as array<string>)")))
    r = r.withColumn("x", F.when(ok, x)).withColumn("gold", gold)
    derived = {
        "thinking_effort": F.col("decode.thinking_effort"),
        "max_tokens": F.col("decode.max_tokens"),
        "temperature": F.col("decode.temperature"),
        "quantization": F.coalesce("quantization", F.lit("unknown")),
        "reasoning_format": F.lit("reasoning_effort"),
        "include_sampling_params": F.lit(True),
        "max_tokens_field": F.lit("max_tokens"),
        "gold_letter": F.col("gold"),
        "predicted_letter": F.col("x.letter"),
        "extraction_method": F.coalesce("x.method", F.lit("provider_error")),
        "ambiguous_candidates": F.coalesce("x.candidates", F.expr("cast(array() as array<string>)")),
        "valid": F.col("x.letter").isNotNull(),
        "correct": F.coalesce(F.col("x.letter") == F.col("gold"), F.lit(False)),
        **{n: F.col(f"usage.{n}") for n in ("prompt_tokens", "completion_tokens", "reasoning_tokens")},
        "reasoning_tokens_reported": F.coalesce("usage.reasoning_tokens_reported", F.lit(False)),
        "reasoning_chars": F.char_length(F.coalesce("reasoning_text", F.lit(""))),
        "thinking_chars": text.thinking_chars(F.col("response_text")),
        "response_chars": F.char_length(F.coalesce("response_text", F.lit(""))),
    }
    return r.select(*[derived.get(f.name, F.col(f.name) if f.name in r.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCORED])


def image_manifest(spark: SparkSession, questions: DataFrame, root: str) -> DataFrame:
    """(question_id, camera, path, source_sha256) of the images that stems refer to; sha256 is null where the file is missing."""
    wanted = questions.select("question_id", "image_paths", F.explode(text.cameras(F.col("stem"))).alias("camera")).select("question_id", "camera", F.try_element_at("image_paths", F.col("camera")).alias("path"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_replace("path", r"^file:/*", "/").alias("full"), F.sha2("content", 256).alias("source_sha256"))
    return wanted.withColumn("full", F.concat(F.lit(root.rstrip("/") + "/"), "path")).join(files, "full", "left").drop("full")
