"""Components of links that lie in one task, and in several."""

import random

import pytest

from gaugeworks.llm import components


def least(links):
    up = {x: x for link in links for x in link}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[max(top(a), top(b))] = min(top(a), top(b))
    return {x: top(x) for a, b in links if a != b for x in (a, b)}


@pytest.mark.parametrize(("most", "kind"), [(1 << 18, "long"), (40, "long"), (40, "string")])
def test_components_of_links_in_one_task_and_in_several(spark, monkeypatch, most, kind):
    r, written, real = random.Random(4), [], components.cut
    monkeypatch.setattr(components, "FILE_LINKS", most)
    monkeypatch.setattr(components, "cut", lambda *a: written.append(1) or real(*a))
    of = int if kind == "long" else str
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1001 + i) for i in range(60)]
    links = [(of(a), of(b)) for a, b in [*chain, *star, *((r.randrange(2000, 2400), r.randrange(2000, 2400)) for _ in range(150)), (7, 7)]]
    r.shuffle(links)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "false")
        found = components.components(spark.createDataFrame(links, f"a {kind}, b {kind}").repartition(8)).collect()
    finally:
        spark.conf.set(key, before)
    assert {x["id"]: x["label"] for x in found} == least(links) and len(found) == len(least(links))
    # a chain of 300 takes no round, and so no shuffles, where its links are in one task
    assert (len(written) == 2) == (most > 1000)


def test_no_links(spark):
    assert components.components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0
