"""Files that near dedup writes to the shared folder."""

import random

from gaugeworks.llm import components, neardup


def test_files_of_links_follow_the_documents(spark, monkeypatch):
    r, files = random.Random(5), []

    def counted(df, *most, real=neardup.cut):
        out = real(df, *most)
        files.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(neardup, "cut", counted)
    monkeypatch.setattr(components, "cut", counted)
    base = [[f"w{r.randrange(900)}" for _ in range(60)] for _ in range(20)]
    rows = [(i, " ".join(r.choice(base)[: r.choice([58, 59, 60])])) for i in range(80)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 23)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = neardup.groups(spark.createDataFrame(rows, "doc_id long, text string"), k=2)
        assert found.where("doc_id <> component_id").count() >= 60
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert files and max(files) == 1
