import pytest

from gaugeworks.llm import neardup


def test_neardup_takes_no_percent_that_its_bands_would_lose(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g h")], "doc_id long, text string")
    with pytest.raises(ValueError, match="80"):
        neardup.groups(docs, k=2, percent=79)
    assert {r["component_id"] for r in neardup.groups(docs, k=2, percent=80).collect()} == {1}
