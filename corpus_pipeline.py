"""The corpus pipeline: five stages from raw documents to tokenized ones.

Every stage takes rows as they come: a null or empty text, a null id, repeated rows and ids, an empty table, and columns of any name beside doc_id and text,
which pass through unread (but for n_chars, which follows the text). What a stage does with each is in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import bpe, decontamination, lines, neardup, quality
from gaugeworks.llm.common import remove, scratch, table, unpacked, whole_row


def beside_text(docs: DataFrame) -> DataFrame:
    """docs as (row, doc_id, text), so that columns of any name pass through a stage; the text isn't in the row a second time."""
    return docs.select(whole_row([c for c in docs.columns if c != "text"]).alias("row"), "doc_id", "text")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counts and the trees keep. Each row is judged by its text alone, so that repeated rows and ids share a fate; a null or empty text has no words and goes."""
    own = beside_text(docs)
    verdict = quality.judge(own, quality.learn(docs, table(spark, sf_dir, "labels")), keep_row=True).where("gw_kept")
    return verdict.select(*unpacked(docs.columns, text=F.col("text")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one; a document that has no other lines goes. n_chars follows the text.

    Rows of one id are documents of their own; rows of one id and one text are one, and share a fate. A null id or text stays as it is.
    """
    left = lines.without(docs, lines.duplicates(docs))
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its shingles of five words: the one of the least doc_id.

    Rows of one id are one document: all stay or all go. A null id stays, and so does a text without words, which is like nothing.
    """
    found = neardup.groups(docs, k=5)
    dropped = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)  # a null id meets nothing and stays


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs. Each row is searched by itself; a null or empty text stays."""
    found = decontamination.find(beside_text(docs), table(spark, sf_dir, "benchmark")).where(F.size("gw_runs") == 0)
    return found.select(*unpacked(docs.columns, text=F.col("text")))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each row's token ids and of the text that they decode to; a null text is an empty one."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontaminate),
    ("tokenization", tokenize),
]

#: SQL can express neither the trees nor the tokens; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again by the next. A stage's folder goes when the next is
    written; the last one's, which the result reads, is the caller's to delete with the shared folder."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
