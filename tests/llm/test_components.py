import random

import pytest

from plexgraph.llm.components import UnionFind, components


def expected(links):
    sets = UnionFind()
    for a, b in links:
        sets.union(a, b)
    return {x: sets.find(x) for a, b in links if a != b for x in (a, b)}


@pytest.mark.parametrize("in_one_task", [0, 1 << 20])
def test_components_match_union_find(spark, in_one_task):
    rng = random.Random(1)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(200, i) for i in range(201, 240)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long").repartition(3), in_one_task).collect()}
    assert got == expected(links)


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
