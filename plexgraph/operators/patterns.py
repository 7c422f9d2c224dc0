"""Graph-pattern operators on DataFrames.

Edges are (src, dst, ..). Patterns become joins that Catalyst plans: semi and anti joins for existence, left joins of
pre-aggregated sides for optional parts, so that no cross product of matches arises. Loops (reachability, walks) write
each step to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexgraph.storage import stash

#: Up to so many edges a traversal runs in one task; beyond, as one join a step.
ONE_TASK_EDGES = 2_000_000


def expand(rows: DataFrame, edges: DataFrame, at: str, to: str, reverse: bool = False, props: dict[str, str] | None = None) -> DataFrame:
    """One hop: rows with column `to`, the node at the other end of each edge of node `at`. A row for each edge."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    e = edges.select(F.col(a).alias("__at"), F.col(b).alias(to), *[F.col(p).alias(n) for p, n in (props or {}).items()])
    return rows.join(e, F.col(at) == F.col("__at")).drop("__at")


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def semi(nodes: DataFrame, edges: DataFrame, incoming: bool = False, key: str = "id") -> DataFrame:
    """Nodes with an edge."""
    return nodes.join(edges.select(F.col("dst" if incoming else "src").alias(key)), key, "left_semi")


def anti(nodes: DataFrame, edges: DataFrame, incoming: bool = False, key: str = "id") -> DataFrame:
    """Nodes without an edge."""
    return nodes.join(edges.select(F.col("dst" if incoming else "src").alias(key)), key, "left_anti")


def optional_count(nodes: DataFrame, edges: DataFrame, name: str, incoming: bool = False, distinct: bool = False, key: str = "id") -> DataFrame:
    """nodes with the number of their edges (or of distinct neighbours), 0 where there are none."""
    here, there = ("dst", "src") if incoming else ("src", "dst")
    n = F.count_distinct(there) if distinct else F.count(F.lit(1))
    sums = edges.groupBy(F.col(here).alias(key)).agg(n.alias(name))
    return nodes.join(sums, key, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))


def optional_collect(nodes: DataFrame, edges: DataFrame, values: DataFrame, value: str, name: str, incoming: bool = False, key: str = "id") -> DataFrame:
    """nodes with the sorted distinct values of their neighbours; empty where there are none. values: (id, value)."""
    here, there = ("dst", "src") if incoming else ("src", "dst")
    found = edges.select(F.col(here).alias(key), F.col(there).alias("__to")).join(values.select(F.col("id").alias("__to"), value), "__to")
    lists = found.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(name))
    return nodes.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(dict(lists.dtypes)[name])))


def degree(edges: DataFrame, key: str = "id", name: str = "degree") -> DataFrame:
    """Edge ends at each node: a self-loop counts twice."""
    return undirected(edges).groupBy(F.col("src").alias(key)).agg(F.count(F.lit(1)).alias(name))


def top_k(rows: DataFrame, by: list[Column], k: int) -> DataFrame:
    """Sort and limit: one TakeOrdered, without a full sort. `by` needs a unique tie-break."""
    return rows.orderBy(*by).limit(k)


def walks(seeds: DataFrame, edges: DataFrame, least: int, most: int, distinct: bool = False) -> DataFrame:
    """(start, node, depth) for every walk of least..most edges; with distinct, each such row once, which keeps every
    step to nodes times starts. seeds: (start)."""
    step = edges.select(F.col("src").alias("node"), F.col("dst").alias("__next"))
    front = seeds.select("start", F.col("start").alias("node"))
    out = []
    for depth in range(1, most + 1):
        front = front.join(step, "node").select("start", F.col("__next").alias("node"))
        front = stash(front.distinct() if distinct else front, "walk")
        if depth >= least:
            out.append(front.withColumn("depth", F.lit(depth).cast("long")))
        if front.isEmpty():
            break
    if not out:
        return seeds.select("start", F.col("start").alias("node"), F.lit(0).cast("long").alias("depth")).limit(0)
    return reduce(DataFrame.unionByName, out)


def all_walks(seeds: DataFrame, edges: DataFrame, least: int, most: int) -> DataFrame:
    """(start, node, depth) with a row for every walk. The steps carry the number of walks, so none is larger than nodes
    times starts; rows are repeated at the end only, in arrays of at most 4096."""
    step = edges.groupBy(F.col("src").alias("node"), F.col("dst").alias("__next")).agg(F.count(F.lit(1)).alias("__e"))
    front, out = seeds.select("start", F.col("start").alias("node"), F.lit(1).cast("long").alias("__n")), []
    for depth in range(1, most + 1):
        front = front.join(step, "node").groupBy("start", F.col("__next").alias("node")).agg(F.sum(F.col("__n") * F.col("__e")).alias("__n"))
        front = stash(front, "walk")
        if depth >= least:
            out.append(front.withColumn("depth", F.lit(depth).cast("long")))
        if front.isEmpty():
            break
    if not out:
        return seeds.select("start", F.col("start").alias("node"), F.lit(0).cast("long").alias("depth")).limit(0)
    return repeated(reduce(DataFrame.unionByName, out), "__n").select("start", "node", "depth")


def paths(seeds: DataFrame, edges: DataFrame, least: int, most: int | None, close: bool = False) -> DataFrame:
    """(start, node, depth, path) for every path of least..most edges (most None: of any length) that repeats no node;
    with close, for every cycle instead: the last step returns to the start, which stands at both ends of its path. path:
    array of ids."""
    if close:
        return circuits(seeds, edges, least, most)
    step = edges.select(F.col("src").alias("node"), F.col("dst").alias("__next"))
    front = seeds.select("start", F.col("start").alias("node"), F.array("start").alias("path"))
    out, depth = [], 0
    while most is None or depth < most:
        depth += 1
        grown = front.join(step, "node").filter(~F.array_contains("path", F.col("__next")))
        front = stash(grown.select("start", F.col("__next").alias("node"), F.array_append("path", F.col("__next")).alias("path")), "path")
        if front.isEmpty():
            break
        if depth >= least:
            out.append(front.withColumn("depth", F.lit(depth).cast("long")))
    if not out:
        return front.withColumn("depth", F.lit(0).cast("long")).limit(0)
    return reduce(DataFrame.unionByName, out)


def circuits(seeds: DataFrame, edges: DataFrame, least: int, most: int | None = None, values: bool = True, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(start, node, depth, path) for every cycle of least..most edges that repeats no node but its start, node being the
    start; a row for each choice among parallel edges. Without values there is no path, and no row holds a whole cycle.

    Nodes with one edge in and one out are contracted first, so that a ring is found without following it and a step of
    the search passes a whole chain. A cycle is found once, from its least chain that holds a start, then given to each
    of its starts. seeds: (start).
    """
    e = stash(edges.dropna(subset=["src", "dst"]).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")), "circuit-edges")
    kind = dict(e.dtypes)["src"]
    if e.count() <= one_task:
        found = e.coalesce(1).mapInPandas(_chains, f"src {kind}, dst {kind}, n long, head {kind}, first {kind}, pos long")
    else:
        found = chains(on_cycles(e))
    asked = seeds.select(F.col("start").alias("src"), F.lit(True).alias("__asked")).distinct()
    parts = found.join(asked, "src", "left").withColumn("asked", F.coalesce("__asked", F.lit(False))).withColumn("link", F.struct("head", "first"))
    parts = stash(parts.select("src", "dst", "n", "head", "link", "pos", "asked"), "chains")
    sums = [F.max_by("dst", "pos").alias("tail"), F.max("asked").alias("asked"), F.count(F.lit(1)).alias("depth"), F.collect_list(F.when(F.col("n") > 1, F.col("n"))).alias("__n")]
    links = parts.groupBy("head", "link").agg(*sums).withColumn("n", F.expr("aggregate(__n, 1L, (a, b) -> a * b)")).drop("__n")
    links = stash(links if most is None else links.filter(F.col("depth") <= most), "links")

    step = links.select(F.col("head").alias("node"), F.col("link").alias("__link"), F.col("tail").alias("__tail"), F.col("asked").alias("__asked"), F.col("depth").alias("__depth"), F.col("n").alias("__n"))
    front = links.filter("asked").select("head", F.col("tail").alias("node"), F.array("head", "tail").alias("seen"), F.array("link").alias("links"), "depth", "n")
    out = []
    while True:
        out.append(front.filter((F.col("node") == F.col("head")) & (F.col("depth") >= least)).select("links", "depth", "n"))
        later = ~F.col("__asked") | (F.col("__link") > F.col("links")[0])
        fresh = (F.col("__tail") == F.col("head")) | ~F.array_contains("seen", F.col("__tail"))
        grown = front.filter(F.col("node") != F.col("head")).join(step, "node").filter(later & fresh)
        grown = grown if most is None else grown.filter(F.col("depth") + F.col("__depth") <= most)
        longer = [F.array_append("seen", F.col("__tail")).alias("seen"), F.array_append("links", F.col("__link")).alias("links"), (F.col("depth") + F.col("__depth")).alias("depth"), (F.col("n") * F.col("__n")).alias("n")]
        front = stash(grown.select("head", F.col("__tail").alias("node"), *longer), "circuit")
        if front.isEmpty():
            break
    cycles_ = reduce(DataFrame.unionByName, out)
    if values:
        cycles_ = stash(cycles_.withColumn("id", F.monotonically_increasing_id()), "cycles")
        one = F.struct("pos", F.col("src").alias("node"), "asked")
        nodes = parts.groupBy("link").agg(F.array_sort(F.collect_list(one)).alias("nodes"))
        each = cycles_.select("id", "depth", "n", F.posexplode("links").alias("at", "link")).join(nodes, "link")
        whole = each.groupBy("id", "depth", "n").agg(F.array_sort(F.collect_list(F.struct("at", "nodes"))).alias("__all"))
        whole = whole.select("depth", "n", F.flatten("__all.nodes").alias("nodes"))
        rows = whole.select("depth", "n", F.col("nodes.node").alias("nodes"), F.explode(F.expr("filter(sequence(1, size(nodes)), i -> nodes[i - 1].asked)")).alias("__at"))
        rows = rows.withColumn("start", F.expr("nodes[__at - 1]")).withColumn("path", F.expr("concat(slice(nodes, __at, size(nodes)), slice(nodes, 1, __at))"))
    else:
        rows = cycles_.select("depth", "n", F.explode("links").alias("link")).join(parts.filter("asked").select("link", F.col("src").alias("start")), "link")
    rows = repeated(seeds.select("start").join(rows, "start"), "n")
    return rows.select("start", F.col("start").alias("node"), "depth", *(["path"] if values else []))


def repeated(rows: DataFrame, times: str) -> DataFrame:
    """Each row so often as it says, from arrays of at most 4096."""
    parts = rows.withColumn("__i", F.explode(F.expr(f"sequence(0L, ({times} - 1) div 4096)")))
    return parts.withColumn("__j", F.explode(F.expr(f"sequence(1L, least(4096L, {times} - 4096 * __i))")))


def _components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The strongly connected component of each node 0..n-1 under edges a -> b (Tarjan, without recursion)."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))])
    at, end, to = ends[:-1].tolist(), ends[1:].tolist(), b[np.argsort(a, kind="stable")].tolist()
    num, low, comp = [0] * n, [0] * n, [-1] * n
    count, kinds, open_ = 0, 0, []
    for root in range(n):
        if num[root]:
            continue
        work = [root]
        while work:
            v = work[-1]
            if not num[v]:
                count += 1
                num[v] = low[v] = count
                open_.append(v)
            if at[v] < end[v]:
                w = to[at[v]]
                at[v] += 1
                if not num[w]:
                    work.append(w)
                elif comp[w] < 0 and num[w] < low[v]:
                    low[v] = num[w]
                continue
            work.pop()
            if work and low[v] < low[work[-1]]:
                low[work[-1]] = low[v]
            if low[v] == num[v]:
                while comp[v] < 0:
                    comp[open_.pop()] = kinds
                kinds += 1
    return np.array(comp, dtype="int64")


def _chains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What chains() gives, for the edges within a strongly connected component, in one task. Ids become numbers as they
    are read."""
    code: dict = {}
    read = [[np.array([code.setdefault(x, len(code)) for x in pdf[c].tolist()], dtype="int64") for c in ("src", "dst")] + [pdf["n"].to_numpy("int64")] for pdf in batches]
    if not code:
        return
    a, b, times = (np.concatenate(x) for x in zip(*read))
    order = sorted(code)
    rank, n = np.empty(len(order), dtype="int64"), len(order)
    rank[[code[x] for x in order]] = np.arange(n)
    names = np.array(order, dtype=object)
    del read, code, order
    a, b = rank[a], rank[b]
    comp = _components(a, b, n)
    kept = comp[a] == comp[b]
    a, b, times = a[kept], b[kept], times[kept]
    single = (np.bincount(a, minlength=n) == 1) & (np.bincount(b, minlength=n) == 1)
    after = np.full(n, -1)
    after[a] = np.arange(len(a))  # read at single nodes only
    starts = [*np.flatnonzero(~single[a]).tolist(), *after[np.flatnonzero(single)].tolist()]
    inner, after, source, target = single.tolist(), after.tolist(), a.tolist(), b.tolist()
    head, first, pos = [-1] * len(a), [-1] * len(a), [0] * len(a)
    # Chains from a node with several edges, then what is left: rings, from their least node.
    for i in starts:
        h, place = source[i], 0
        f = h if inner[h] else target[i]
        while head[i] < 0:
            head[i], first[i], pos[i] = h, f, place
            if inner[target[i]]:
                i, place = after[target[i]], place + 1
    head, first, pos = (np.array(x, dtype="int64") for x in (head, first, pos))
    for i in range(0, len(a), 100_000):
        p = slice(i, i + 100_000)
        yield pd.DataFrame({"src": names[a[p]], "dst": names[b[p]], "n": times[p], "head": names[head[p]], "first": names[first[p]], "pos": pos[p]})


def chains(edges: DataFrame) -> DataFrame:
    """(src, dst, n, head, first, pos): the chain that each edge (src, dst, n) is in, and its place there. A chain goes
    from a node, the head, to the next that has not one edge in and one out; head and first, the node after it, tell
    chains apart. A ring of such nodes is one chain whose head and first are its least node. Pointers to earlier nodes
    double their reach in each step. Every source of an edge is a target too."""
    one = F.count(F.lit(1)) == 1
    ins, outs = (edges.groupBy(F.col(c).alias("v")).agg(one.alias("__one")).filter("__one").select("v") for c in ("dst", "src"))
    single = stash(ins.join(outs, "v"), "single")
    inner = single.select(F.col("v").alias("to"), F.lit(True).alias("__open"))
    back = edges.select(F.col("dst").alias("v"), F.col("src").alias("to")).join(single, "v").join(inner, "to", "left")
    state = back.select("v", "to", F.col("v").alias("last"), F.lit(1).cast("long").alias("dist"), F.struct(F.col("v").alias("node"), F.lit(0).cast("long").alias("dist")).alias("least"), F.coalesce("__open", F.lit(False)).alias("open"), F.lit(True).alias("moved"))
    state = stash(state, "chain")
    # As long as a chain has rows that point into it, one of them gets to its head in each step; on a ring a step without
    # a change means that all know the least node.
    while not state.filter("moved").isEmpty():
        far = state.select(F.col("v").alias("to"), *[F.col(c).alias(f"__{c}") for c in ("to", "last", "dist", "least", "open")])
        least = F.least("least", F.struct(F.col("__least.node").alias("node"), (F.col("dist") + F.col("__least.dist")).alias("dist")))
        moved = (least != F.col("least")) | ~F.col("__open")
        grown = state.filter("open").join(far, "to").select("v", F.col("__to").alias("to"), F.col("__last").alias("last"), (F.col("dist") + F.col("__dist")).alias("dist"), least.alias("least"), F.col("__open").alias("open"), moved.alias("moved"))
        state = stash(grown.unionByName(state.filter("NOT open").withColumn("moved", F.lit(False))), "chain")
    places = state.select(F.col("v").alias("src"), F.when(F.col("open"), F.struct(F.col("least.node").alias("head"), F.col("least.node").alias("first"), F.col("least.dist").alias("pos"))).otherwise(F.struct(F.col("to").alias("head"), F.col("last").alias("first"), F.col("dist").alias("pos"))).alias("__place"))
    own = F.struct(F.col("src").alias("head"), F.col("dst").alias("first"), F.lit(0).cast("long").alias("pos"))
    return edges.join(places, "src", "left").withColumn("__place", F.coalesce("__place", own)).select("src", "dst", "n", "__place.*")


def on_cycles(edges: DataFrame) -> DataFrame:
    """edges without those that lead only to dead ends or come only from sources: no cycle uses them."""
    left, n = stash(edges, "trimmed"), edges.count()
    while True:
        kept = semi(semi(left, left, key="dst"), left, incoming=True, key="src")
        left, before = stash(kept.select(edges.columns), "trimmed"), n
        n = left.count()
        if n == before:
            return left


def closures(seeds: DataFrame, edges: DataFrame, least: int) -> DataFrame:
    """(start, node, depth): the starts that a walk of at least `least` edges leads back to, node being the start, with
    the least such depth. Goes on until no step finds a new pair of start and node."""
    step = on_cycles(edges.select("src", "dst").distinct()).select(F.col("src").alias("node"), F.col("dst").alias("__next"))
    front, depth = seeds.select("start", F.col("start").alias("node")), 0
    seen = None
    while True:
        depth += 1
        new = front.join(step, "node").select("start", F.col("__next").alias("node")).distinct()
        if seen is not None:
            new = new.join(seen, ["start", "node"], "left_anti")
        front = stash(new.withColumn("depth", F.lit(depth).cast("long")), "closures")
        if depth >= least:
            seen = front if seen is None else seen.unionByName(front)
        if front.isEmpty():
            return (front if seen is None else seen).filter(F.col("start") == F.col("node"))


def cycles(edges: DataFrame, least: int, most: int) -> DataFrame:
    """(node, length) of closed walks of least..most edges."""
    seeds = edges.select(F.col("src").alias("start")).distinct()
    return walks(seeds, edges, least, most, distinct=True).filter(F.col("start") == F.col("node")).select("node", F.col("depth").alias("length"))


def _search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Breadth-first search in one task: rows with dst null are starts."""
    nxt: dict[int, list[int]] = {}
    starts: list[int] = []
    for pdf in batches:
        e = pdf.dropna()
        for a, b in zip(e["src"].astype("int64").tolist(), e["dst"].astype("int64").tolist()):
            nxt.setdefault(a, []).append(b)
        starts += pdf.loc[pdf["dst"].isna(), "src"].astype("int64").tolist()
    seen, front, depth = dict.fromkeys(starts, 0), list(dict.fromkeys(starts)), 0
    while front:
        depth += 1
        new = []
        for a in front:
            for b in nxt.get(a, ()):
                if b not in seen:
                    seen[b] = depth
                    new.append(b)
        front = new
    yield pd.DataFrame({"node": list(seen), "distance": list(seen.values())}, dtype="int64")


def reach(seeds: DataFrame, edges: DataFrame, reverse: bool = False, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, distance): every node reachable from any seed, the seeds at 0, with its least distance. seeds: (id)."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    step = edges.select(F.col(a).cast("long").alias("src"), F.col(b).cast("long").alias("dst")).distinct()
    start = seeds.select(F.col("id").cast("long").alias("src"), F.lit(None).cast("long").alias("dst")).distinct()
    step = stash(step, "reach-edges")
    if step.count() <= one_task:
        return step.unionByName(start).coalesce(1).mapInPandas(_search, "node long, distance long")
    seen = stash(start.select(F.col("src").alias("node"), F.lit(0).cast("long").alias("distance")), "reach")
    front, depth = seen, 0
    while not front.isEmpty():
        depth += 1
        new = front.join(step, front["node"] == step["src"]).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        front = stash(new.withColumn("distance", F.lit(depth).cast("long")), "reach")
        seen = seen.unionByName(front)
    return seen


def _search_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Breadth-first search from each start, in one task."""
    nxt: dict[str, list[str]] = {}
    starts: list[str] = []
    for pdf in batches:
        e = pdf.dropna()
        for a, b in zip(e["src"].tolist(), e["dst"].tolist()):
            nxt.setdefault(a, []).append(b)
        starts += pdf.loc[pdf["dst"].isna(), "src"].tolist()
    for s in starts:
        seen, front, depth = {}, [s], 0
        while front:
            depth += 1
            new = [b for b in dict.fromkeys(b for a in front for b in nxt.get(a, ())) if b not in seen]
            seen |= dict.fromkeys(new, depth)
            front = new
        yield pd.DataFrame({"start": s, "node": list(seen), "depth": list(seen.values())}).astype({"depth": "int64", "start": "str", "node": "str"})


def reach_pairs(seeds: DataFrame, edges: DataFrame, one_task: int = ONE_TASK_EDGES, few: int = 100) -> DataFrame:
    """(start, node, depth): every node that a walk of one edge or more reaches from each start, at its least depth.
    Few starts over edges of a checked size are searched in one task; else each step keeps new pairs only, so cycles
    end. seeds: (start)."""
    text = dict(edges.dtypes)["src"] == "string"
    if text and seeds.count() <= few and edges.count() <= one_task:
        asked = seeds.select(F.col("start").alias("src"), F.lit(None).cast("string").alias("dst"))
        return edges.select("src", "dst").distinct().unionByName(asked).coalesce(1).mapInPandas(_search_pairs, "start string, node string, depth long")
    step = edges.select(F.col("src").alias("node"), F.col("dst").alias("__next")).distinct()
    front, seen, depth = seeds.select("start", F.col("start").alias("node")), None, 0
    while True:
        depth += 1
        new = front.join(step, "node").select("start", F.col("__next").alias("node")).distinct()
        if seen is not None:
            new = new.join(seen, ["start", "node"], "left_anti")
        front = stash(new.withColumn("depth", F.lit(depth).cast("long")), "pairs")
        seen = front if seen is None else seen.unionByName(front)
        if front.isEmpty():
            return seen


def quota(rows: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """The first `most` rows of each kind: a window rank, pruned before the shuffle."""
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most).drop("__n")


def induced(edges: DataFrame, nodes: DataFrame, key: str = "gid") -> DataFrame:
    """Edges with both ends among nodes."""
    a, b = nodes.select(F.col(key).alias("src")).distinct(), nodes.select(F.col(key).alias("dst")).distinct()
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi")


def smallest_enclosing(points: DataFrame, spans: DataFrame, group: str, point: str, low: str, high: str, span_id: str) -> DataFrame:
    """points with span_id, the shortest span of their group that encloses them (null if none; ties: least start, id).

    The join is on the group and a bucket of the span's length class: a point looks up one cell in each class that its
    group has, so a long file costs no product of points and spans.
    """
    size = F.greatest(F.col(high) - F.col(low) + 1, F.lit(1))
    level = F.ceil(F.log2(size)).cast("int")
    wide = F.expr("shiftleft(1L, __level)")
    s = spans.select(F.col(group).alias("__g"), F.col(low).cast("long").alias("__lo"), F.col(high).cast("long").alias("__hi"), F.col(span_id).alias("__id"), level.alias("__level"))
    s = s.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("__lo") / wide), F.floor(F.col("__hi") / wide))))
    levels = s.select("__g", "__level").distinct()
    # Looked up once for each place, however many points stand there.
    places = points.select(F.col(group).alias("__g"), F.col(point).cast("long").alias("__p")).distinct()
    asked = places.join(levels, "__g").withColumn("__cell", F.floor(F.col("__p") / wide))
    hit = asked.join(s, ["__g", "__level", "__cell"]).filter((F.col("__lo") <= F.col("__p")) & (F.col("__p") <= F.col("__hi")))
    best = hit.groupBy("__g", "__p").agg(F.min(F.struct((F.col("__hi") - F.col("__lo")).alias("n"), "__lo", "__id")).alias("__best"))
    at = (F.col(group) == F.col("__g")) & (F.col(point) == F.col("__p"))
    return points.join(best, at, "left").withColumn(span_id, F.col("__best.__id")).drop("__g", "__p", "__best")


def nearest_after(left: DataFrame, right: DataFrame, group: list[str], at: str, most, right_id: str) -> DataFrame:
    """left with right_id, the first row of right in the same group at the same place or within `most` after it
    (null if none).

    One sorted window over both sides instead of a join: the next right row is carried backwards.
    """
    r = right.select(*group, F.col(at), F.struct(F.col(at).alias("a"), F.col(right_id).alias("i")).alias("__r"), F.lit(1).alias("__side"))
    both = left.withColumn("__r", F.lit(None).cast(r.schema["__r"].dataType)).withColumn("__side", F.lit(0)).unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*group).orderBy(F.col(at).desc(), F.col("__side").desc(), F.col("__r.i").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = both.withColumn("__next", F.last("__r", ignorenulls=True).over(w)).filter("__side = 0")
    near = F.when(F.col("__next.a") - F.col(at) <= most, F.col("__next.i"))
    return carried.withColumn(right_id, near).drop("__r", "__side", "__next")


def first_of(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first by order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") == 1).drop("__n")


def changes(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): added, modified, removed or unchanged, from one full outer join."""
    o, n = old.select(key, F.col(digest).alias("__old")), new.select(key, F.col(digest).alias("__new"))
    kind = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.col("__old") != F.col("__new"), "modified").otherwise("unchanged")
    return o.join(n, key, "full_outer").select(key, kind.alias("change"))
