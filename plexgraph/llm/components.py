"""Connected components of a graph of links, by union-find.

Each partition reduces its links to a forest. If the forests together are small, which is checked, one task joins them;
otherwise alternating stars do, as DataFrame joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexgraph.llm.common import stash


#: Links, after each partition has reduced its own to a forest, that one task may join.
IN_ONE_TASK = 200_000


class UnionFind:
    """Disjoint sets whose root is their least member."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while x != root:
            self.parent[x], x = root, self.parent.get(x, x)
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        self.parent.setdefault(min(a, b), min(a, b))


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links of a partition as one link from each node to the least of its set: at most one a node."""
    sets = UnionFind()
    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            sets.union(a, b)
    rows = [(x, r) for x in sets.parent if (r := sets.find(x)) != x]
    yield pd.DataFrame(rows, columns=["a", "b"]).astype("int64")


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def _rooted(links: DataFrame) -> DataFrame:
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def components(links: DataFrame, in_one_task: int = IN_ONE_TASK, stash=stash) -> DataFrame:
    """links: (a, b), longs. (node, root) for every linked node, root being the least node of its component. stash stores
    a table and returns it read again."""
    links = links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # `a` is the larger end from here on.
    links = stash(links.mapInPandas(_forest, "a long, b long"), "links")
    if links.count() <= in_one_task:
        links = stash(links.coalesce(1).mapInPandas(_forest, "a long, b long"), "links")
        return _rooted(links)
    links = stash(links.distinct(), "links")
    state = _state(links)
    while state[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stash(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "links-min")
        large = stash(both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "links-large")
        least = stash(large.groupBy("a").agg(F.min("b").alias("m")), "links-min")
        small = large.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = stash(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        before, state = state, _state(links)
        if state == before:
            break
    return _rooted(links)
