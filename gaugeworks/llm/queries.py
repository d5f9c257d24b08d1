"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import bpe, chat, decontamination, lines, neardup, pii, quality, sharding, suffix, warc
from gaugeworks.llm.common import scratch, table

#: Where the public tokenizer files are.
BPE_FILE = "byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in eight shards of the corpus mixture."""
    return sharding.interleave(table(spark, sf_dir, "documents")).drop("stratum")


SQL["op7_sharding"] = r"""
    WITH t AS (
        -- the table of the checksum, from its rule
        SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_of
    ), d AS (
        SELECT doc_id, coalesce('=' || source, '') AS stratum, strlen(coalesce(text, '')) + 1 AS size,
               ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS h,
               xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
                               lambda c, b: xor(c >> 8, crc_of[(xor(c, b) & 255) + 1])), 4294967295) AS crc
        FROM documents, t
    ), r AS (
        SELECT *, (2 * row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id NULLS FIRST, size, crc) - 1)::DOUBLE / (2 * count(*) OVER (PARTITION BY stratum)) AS fraction, count(*) OVER () AS n
        FROM d
    ), p AS (SELECT *, row_number() OVER (ORDER BY fraction, stratum, h, doc_id NULLS FIRST, size, crc) - 1 AS k FROM r),
    s AS (SELECT *, (k * 8) // n AS shard FROM p)
    SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'rows' AS law, shard::INT AS shard, (row_number() OVER (PARTITION BY shard ORDER BY k) - 1)::BIGINT AS slot, NULL::INT AS grown_shard
    FROM s
"""


@query
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text that they decode to, as digests."""
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE))


@query
def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as prefix-target examples, read back."""
    text = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.examples(rows.unionByName(more)))


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records and read back."""
    path = scratch(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path, payload=False).drop("payload", "url")


SQL["op10_warc"] = """
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, d AS payload_digest,
           CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN page_id < keeper THEN keeper END AS refers_to
    FROM (
        SELECT *, max(page_id) OVER (PARTITION BY d) AS keeper
        FROM (
            SELECT page_id, html,
                   array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
                       ((('0x' || substr(h, 1 + (5 * i) // 4, 2 + (CASE WHEN i % 8 IN (1, 3, 4, 6) THEN 0 ELSE 0 END)))::BIGINT)
                       >> (3 - (5 * i) % 4)) & 31)::INT, 1) FOR i IN range(32)], '') AS d
            FROM (SELECT page_id, html, sha1(coalesce(html, '')) || '0' AS h FROM pages)
        )
    )
"""


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, score and verdict of every document; trees fitted on the labelled documents."""
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


@query
def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of ``op8_quality``, and whether they alone reject a document."""
    return quality.judge(table(spark, sf_dir, "documents"), None).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


SQL["quality_base_counts"] = r"""
    WITH d AS (
        SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), v AS (
        SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c
        FROM (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8))
    ), m AS (
        SELECT doc_id, count(DISTINCT k) AS c FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM v WHERE c > 1) GROUP BY doc_id
    ), l AS (
        SELECT doc_id, count(*) - count(DISTINCT x) AS c
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id
    )
    SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.c, 0)::BIGINT AS n_dup_lines, coalesce(m.c, 0)::BIGINT AS n_repeat_words,
           len(w) < 20 OR 100 * coalesce(m.c, 0) > 30 * len(w) AS base_failed
    FROM d LEFT JOIN l USING (doc_id) LEFT JOIN m USING (doc_id)
"""


@query
def pii_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of the fixed patterns of ``op1_pii`` by kind."""
    return pii.report(table(spark, sf_dir, "documents")).select("doc_id", *(f"n_{k}" for k in pii.KINDS))


SQL["pii_base_counts"] = r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
    SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'))::BIGINT AS n_email,
           len(list_filter(regexp_extract_all(text, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'),
                           lambda x: list_bool_and([length(ltrim(p, '0')) <= 3 AND coalesce(try_cast(p AS BIGINT), 999) <= 255 FOR p IN string_split(x, '.')])))::BIGINT AS n_ip,
           len(list_filter(regexp_extract_all(text, '[0-9](?:[ -]?[0-9])+'),
                           lambda x: length(replace(replace(x, ' ', ''), '-', '')) BETWEEN 16 AND 19
                                     AND list_sum([CASE WHEN i % 2 = 1 THEN c ELSE 2 * c - 9 * (2 * c > 9)::INT END FOR c, i IN [x::INT FOR x IN string_split(reverse(replace(replace(x, ' ', ''), '-', '')), '')]]) % 10 = 0))::BIGINT AS n_card,
           len(list_filter(regexp_extract_all(text, '\+[0-9][ ().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 8 AND 15))::BIGINT AS n_phone
    FROM d
"""


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op2_decontamination"] = r"""
    WITH d AS (
        SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w
        FROM documents
    ), b AS (
        SELECT item_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w
        FROM benchmark
    ), p AS (
        SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
        FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
    ), sizes AS (SELECT DISTINCT n FROM p),
    v AS (
        SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
    ), m AS (SELECT v.doc_id, v.n, v.i, p.item_id FROM v JOIN p ON v.n = p.n AND v.g = p.g),
    h AS (SELECT doc_id, count(DISTINCT k) AS c FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM m) GROUP BY doc_id),
    t AS (SELECT doc_id, count(DISTINCT item_id) AS c, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM m GROUP BY doc_id)
    SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.c, 0)::BIGINT AS n_hit, coalesce(t.c, 0)::BIGINT AS n_items,
           sha256(coalesce(t.s, '')) AS items_sha256, coalesce(h.c, 0) > 0 AS contaminated
    FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: the fixed patterns, and what the tagger adds."""
    return pii.report(table(spark, sf_dir, "documents"))


@query
def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that share four fifths of their word pairs."""
    found = neardup.groups(table(spark, sf_dir, "documents"), k=2)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


@query
def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that repeat an earlier line, or nearly so."""
    return lines.report(table(spark, sf_dir, "documents"))


@query
def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that strings of 400 bytes found elsewhere cover."""
    return suffix.report(table(spark, sf_dir, "documents"))


SQL["op4_chat"] = r"""
    WITH c AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
    ), n AS (
        SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS k,
               sum(23 + length(role) + length(text) + len(regexp_extract_all(role, p)) + len(regexp_extract_all(text, p))) OVER (w ROWS UNBOUNDED PRECEDING) AS upto
        FROM c, (SELECT '\\|<\|turn\|>|<\|text\|>|<\|end\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>' AS p)
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
    )
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(upto) FILTER (role = 'assistant' OR i = k)::BIGINT AS formatted_chars, count(*) FILTER (role = 'assistant' OR i = k) AS n_examples
    FROM n GROUP BY conv_id
"""
