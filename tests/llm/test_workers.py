"""What Python workers still hold when a stage is over."""

import public_tokenizers

from gaugeworks.llm import bpe


def test_tokenization_leaves_no_words_in_workers(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")

    def held(batches):
        import pyarrow as pa

        for _ in batches:
            n = len(bpe.codec(path).ids) if bpe.codec.cache_info().currsize else 0
            yield pa.RecordBatch.from_pydict({"words": [n], "loaded": [bpe.codec.cache_info().currsize]})

    docs = spark.range(2000).selectExpr("id as doc_id", "concat_ws(' ', 'word', id, id * 7, 'zqx' || id) as text").repartition(8)
    assert bpe.digests(docs, path).where("n_tokens > 0").count() == 2000
    # so many tasks that each idle worker has one
    rows = spark.range(0, 64, 1, 64).mapInArrow(held, "words long, loaded long").collect()
    assert sum(r["loaded"] for r in rows) > 0
    assert sum(r["words"] for r in rows) == 0
