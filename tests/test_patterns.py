import random

import pytest

from plexgraph.functions import text as X
from plexgraph.operators import patterns as P
from plexgraph.operators.resolution import best_symbols, resolve, with_suffixes
from plexgraph.sources.discover import excluded, file_type


def graph(spark, n=40, m=70, seed=1):
    rng = random.Random(seed)
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    return pairs, spark.createDataFrame(pairs, "src long, dst long")


def distances(pairs, starts):
    seen, front, d = dict.fromkeys(starts, 0), list(starts), 0
    while front:
        d += 1
        front = [b for b in {b for a, b in pairs if a in front} if b not in seen]
        seen |= dict.fromkeys(front, d)
    return seen


@pytest.mark.parametrize("one_task", [0, 1000])
def test_reach(spark, one_task):
    pairs, edges = graph(spark)
    seeds = spark.createDataFrame([(1,), (2,)], "id long")
    assert dict(map(tuple, P.reach(seeds, edges, one_task=one_task).collect())) == distances(pairs, [1, 2])
    back = [(b, a) for a, b in pairs]
    assert dict(map(tuple, P.reach(seeds, edges, reverse=True, one_task=one_task).collect())) == distances(back, [1, 2])


@pytest.mark.parametrize("one_task", [0, 1000])
def test_reach_pairs(spark, one_task):
    pairs, edges = graph(spark, 20, 26)
    e = edges.selectExpr("cast(src as string) src", "cast(dst as string) dst")
    got = {(r.start, r.node): r.depth for r in P.reach_pairs(spark.createDataFrame([("1",), ("5",)], "start string"), e, one_task=one_task).collect()}
    want = {}
    for s in (1, 5):
        front, d, seen = {s}, 0, {}
        while front:
            d += 1
            front = {b for a, b in pairs if a in front} - set(seen)
            seen |= dict.fromkeys(front, d)
        want |= {(str(s), str(k)): v for k, v in seen.items()}
    assert got == want


def test_walks_paths_and_cycles(spark):
    pairs = [(1, 2), (2, 3), (3, 1), (2, 4), (4, 2)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    seeds = spark.createDataFrame([(1,)], "start long")
    walks = {(1,): 1}
    assert sorted((r.node, r.depth) for r in P.walks(seeds, edges, 1, 3).collect()) == [(1, 3), (2, 1), (2, 3), (3, 2), (4, 2)] and walks
    assert sorted(r.path for r in P.paths(seeds, edges, 1, 30).collect()) == [[1, 2], [1, 2, 3], [1, 2, 4]]
    assert sorted(map(tuple, P.cycles(edges, 2, 3).collect())) == [(1, 3), (2, 2), (2, 3), (3, 3), (4, 2)]
    assert P.walks(seeds.limit(0), edges, 1, 3).count() == 0


def test_smallest_enclosing_equals_brute_force(spark):
    rng = random.Random(4)
    spans = [(f"f{rng.randrange(3)}", a := rng.randrange(200), a + rng.randrange(80), i) for i in range(120)]
    points = [(f"f{rng.randrange(4)}", rng.randrange(260)) for _ in range(150)]
    got = P.smallest_enclosing(spark.createDataFrame(points, "f string, p long"), spark.createDataFrame(spans, "f string, a long, b long, i long"), "f", "p", "a", "b", "i").collect()
    want = [(f, p, min(((b - a, a, i) for g, a, b, i in spans if g == f and a <= p <= b), default=(0, 0, None))[2]) for f, p in points]
    assert sorted(map(str, [(r.f, r.p, r.i) for r in got])) == sorted(map(str, want))


def test_nearest_after(spark):
    left = spark.createDataFrame([(1, "a", 10), (2, "a", 20), (3, "b", 5), (4, "a", 90)], "l long, g string, t long")
    right = spark.createDataFrame([(7, "a", 10), (8, "a", 24), (9, "b", 50)], "r long, g string, t long")
    assert {x.l: x.r for x in P.nearest_after(left, right, ["g"], "t", 5, "r").collect()} == {1: 7, 2: 8, 3: None, 4: None}


def test_optional_parts_quota_and_changes(spark):
    nodes, edges = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id long, name string"), spark.createDataFrame([(1, 2), (1, 2), (3, 2)], "src long, dst long")
    assert sorted(map(tuple, P.optional_count(nodes, edges, "n").select("id", "n").collect())) == [(1, 2), (2, 0), (3, 1)]
    assert {r.id: r.v for r in P.optional_collect(nodes, edges, nodes, "name", "v", incoming=True).collect()} == {1: [], 2: ["x", "z"], 3: []}
    assert P.quota(edges, "dst", "src", 2).count() == 2 and P.anti(nodes, edges, incoming=True).count() == 2 and P.semi(nodes, edges).count() == 2
    old, new = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "p string, h string"), spark.createDataFrame([("b", "1"), ("c", "2"), ("d", "1")], "p string, h string")
    assert dict(map(tuple, P.changes(old, new, "p", "h").collect())) == {"a": "removed", "b": "unchanged", "c": "modified", "d": "added"}


def test_resolution(spark):
    s = spark.createDataFrame([("f", "i1", 0, 2), ("f", "i2", 1, 9), ("f", "i3", 1, 3), ("a.b.g", "i4", 0, 1), ("h", "i5", 0, 1)], "key string, id string, weight int, ord int")
    assert dict(map(tuple, best_symbols(s).collect()))["f"] == "i3"
    r = spark.createDataFrame([("r1", ["no", "f"]), ("r2", ["h", "f"]), ("r3", ["no"])], "ref string, candidates array<string>")
    assert dict(map(tuple, resolve(r, s).collect())) == {"r1": "i3", "r2": "i5", "r3": None}
    n = spark.createDataFrame([("r1", "b.g"), ("r2", "x.h"), ("r3", "f"), ("r4", "q")], "ref string, name string")
    assert dict(map(tuple, with_suffixes(n, s).collect())) == {"r1": "i4", "r2": "i5", "r3": "i3", "r4": None}


def test_text_features(spark):
    css = "/* {{ } */ @use './v'; $a: 1px; @mixin m { } .x { .y { .z { color: red } } } :host { } ::ng-deep mat-card { }"
    r = spark.createDataFrame([("a.component.scss", css)], "path string, text string")
    got = r.select(*[c.alias(n) for n, c in X.style_features(r.text, r.path).items()]).first()
    assert got.css_type == "scss" and got.max_nesting == 4 and got.imports == ["./v"] and got.variables == ["a"] and got.mixins == ["m"] and got.is_angular and got.host_rules == 1
    html = r.select(*[c.alias(n) for n, c in X.html_features(__import__("pyspark").sql.functions.lit("<app-a *ngIf='x' [p]='1' (e)='f()'>{{ v }}</app-a><mat-b>")).items()]).first()
    assert html.is_angular and html.components == ["app-a"] and html.material_components == ["mat-b"] and html.directives == ["*ngIf"] and html.interpolations == 1
    assert spark.createDataFrame([("a\n\n# b\n c # d",), (None,)], "t string").select(X.lines_of_code(__import__("pyspark").sql.functions.col("t"))).collect() == [(2,), (0,)]


def test_discovery_rules(spark):
    paths = {"a/b.component.ts": "angular", "a/b.component.html": "angular_template", "x.PY": "python", "Dockerfile": "dockerfile", "a.ts": "typescript", "b.txt": None, "s.scss": "css", "a.component.sass": "angular_style", "b.pyw": "python", "c.pyi": "python", "e.cjs": None, "d.directive.ts": "typescript"}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.t for r in df.select("p", file_type(df.p).alias("t")).collect()} == paths
    out = {"node_modules/a.js": True, "a/.git/x": True, "a/lib/b.py": True, "liberty.py": False, "a/b.pyc": True, "x.min.js": False, "lib/x.py": True, "a/obj/b.ts": True, "a/b.py": False}
    df = spark.createDataFrame([(p,) for p in out], "p string")
    assert {r.p: r.e for r in df.select("p", excluded(df.p).alias("e")).collect()} == out


def test_views(spark):
    from plexgraph.operators import view as V

    nodes = spark.createDataFrame([(1, "File", 0.0, 0.0), (2, "Variable", 5.0, 5.0), (3, "Function", 9.0, 9.0)], "id long, type string, x double, y double")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 3)], "src long, dst long")
    assert [r.id for r in V.level_of_detail(nodes, 0.1).collect()] == [1]
    assert {r.id: r.dimmed for r in V.level_of_detail(nodes, 0.5).collect()} == {1: False, 2: True, 3: False}
    assert not any(r.dimmed for r in V.level_of_detail(nodes, 0.9).collect())
    seen, kept = V.in_window(nodes, edges, (-1, -1, 6, 6))
    assert {r.id for r in seen.collect()} == {1, 2} and sorted(map(tuple, kept.collect())) == [(1, 2), (2, 3)]
    assert V.neighbours(edges, 3).count() == 2


def test_cycles_of_any_length(spark):
    ring = [(str(i), str((i + 1) % 14)) for i in range(14)]
    pairs = ring + [("3", "x"), ("x", "y"), ("z", "0"), ("2", "2"), ("7", "6")]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    seeds = edges.selectExpr("src as start").distinct()
    assert {r.src for r in P.on_cycles(edges).collect()} == {str(i) for i in range(14)}
    for least in (1, 2, 3):
        def lengths(i, least=least):
            front, d = {i}, 0
            while d < 40:
                d += 1
                front = {b for a, b in pairs if a in front}
                if d >= least and i in front:
                    return d

        want = {(i, lengths(i)) for i in {a for a, _ in pairs} if lengths(i)}
        assert {(r.start, r.depth) for r in P.closures(seeds, edges, least).collect()} == want
    got = sorted((r.start, r.depth) for r in P.paths(seeds, edges, 1, None, close=True).collect())
    assert got == sorted([(str(i), 14) for i in range(14)] + [("2", 1), ("6", 2), ("7", 2)])
    assert P.paths(seeds, spark.createDataFrame([("a", "b")], "src string, dst string"), 1, None, close=True).count() == 0


def test_cypher_cycles_beyond_ten_nodes(spark, tmp_path):
    from plexgraph.engine import Engine

    (tmp_path / "src").mkdir()
    for i in range(12):
        (tmp_path / "src" / f"m{i:02}.py").write_text(f"import m{(i + 1) % 12:02}\n\ndef f{i}():\n    return {i}\n")
    for i in range(35):
        (tmp_path / "src" / f"c{i:02}.py").write_text(f"def call{i:02}():\n    return " + (f"call{i + 1:02}()\n" if i < 34 else "1\n"))
    e = Engine(spark, str(tmp_path / "store"))
    e.update(str(tmp_path / "src"))
    assert e.query("MATCH (f:File)-[:IMPORTS]->(g:File) RETURN f.path AS a").count() == 12
    rows = e.query("MATCH path = (f1:File)-[:IMPORTS*2..]->(f1) WHERE length(path) > 2 RETURN path LIMIT 10").collect()
    assert len(rows) == 10 and {r.path.length for r in rows} == {12}
    assert len({r.p for r in e.query("MATCH (f:File)-[:IMPORTS*]->(f) RETURN f.path AS p").collect()}) == 12
    assert {r.n for r in e.query("MATCH path = (f:File)-[:IMPORTS*]->(f) RETURN f.path AS p, length(path) AS n").collect()} == {12}
    far = e.query("MATCH path = (a:Function {name: 'call00'})-[:CALLS*1..50]->(b:Function) RETURN path").collect()
    assert max(r.path.length for r in far) == 34
    far = e.query("MATCH path = (a:Function {name: 'call00'})-[:CALLS*]->(b:Function) RETURN path").collect()
    assert sorted(r.path.length for r in far) == list(range(1, 35))


def test_cypher_counts_every_walk(spark, tmp_path):
    from plexgraph.engine import Engine

    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("def top():\n    left()\n    right()\n\ndef left():\n    low()\n\ndef right():\n    low()\n\ndef low():\n    return 1\n")
    e = Engine(spark, str(tmp_path / "store"))
    e.update(str(tmp_path / "src"))
    ask = lambda out: sorted(map(tuple, e.query(f"MATCH (a:Function {{name: 'top'}})-[:CALLS*1..3]->(b:Function) RETURN {out}").collect()))
    assert ask("b.name AS b, COUNT(*) AS n") == [("left", 1), ("low", 2), ("right", 1)]
    assert ask("b.name AS b") == [("left",), ("low",), ("low",), ("right",)]
    assert ask("DISTINCT b.name AS b") == [("left",), ("low",), ("right",)]
    assert ask("b.name AS b, COUNT(DISTINCT a.name) AS n") == [("left", 1), ("low", 1), ("right", 1)]
    seeds, edges = spark.createDataFrame([("x",)], "start string"), spark.createDataFrame([("x", "y")] * 100 + [("y", "z")] * 50, "src string, dst string")
    assert {(r.node, r["count"]) for r in P.all_walks(seeds, edges, 1, 3).groupBy("node").count().collect()} == {("y", 100), ("z", 5000)}


def closed(pairs, starts, least, most):
    """Every cycle from each start that repeats no other node, once for each choice among parallel edges."""
    out, front = [], [[s] for s in starts]
    while front:
        grown = [[*p, b] for p in front for a, b in pairs if a == p[-1] and (b == p[0] or b not in p)]
        out += [p for p in grown if p[0] == p[-1] and len(p) > least and (most is None or len(p) <= most + 1)]
        front = [p for p in grown if p[0] != p[-1]]
    return sorted(out)


@pytest.mark.parametrize("one_task", [0, 1000])
def test_circuits_equal_brute_force(spark, one_task):
    ring = [(i, (i + 1) % 9) for i in range(9)]
    graphs = [
        ring + [(20 + a, 20 + b) for a, b in ring] + [(3, 25), (4, 4), (30, 31), (31, 0), (40, 41), (41, 42), (42, 40), (42, 43), (41, 42), (50, 50)],
        ring + [(2, 10), (10, 11), (11, 7), (5, 12), (12, 1), (8, 8), (8, 8), (6, 13), (13, 6), (0, 1)],
        [(a, b) for a in range(4) for b in range(4)],
        graph(spark, 12, 22, seed=5)[0],
        [(1, 2), (2, 3)],
    ]
    pairs = [(100 * i + a, 100 * i + b) for i, g in enumerate(graphs) for a, b in g]
    edges, nodes = spark.createDataFrame([*pairs, (None, 1), (1, None)], "src long, dst long"), sorted({x for p in pairs for x in p})
    for starts, least, most in ((nodes, 1, None), (nodes[1::3], 2, None), (nodes, 2, 4)):
        seeds, want = spark.createDataFrame([(s,) for s in starts], "start long"), closed(pairs, starts, least, most)
        got = P.circuits(seeds, edges, least, most, one_task=one_task).collect()
        assert sorted(r.path for r in got) == want and all((r.start, r.node, r.depth) == (r.path[0], r.path[0], len(r.path) - 1) for r in got)
        short = P.circuits(seeds, edges, least, most, values=False, one_task=one_task)
        assert short.columns == ["start", "node", "depth"] and sorted(map(tuple, short.collect())) == sorted((p[0], p[0], len(p) - 1) for p in want)


def test_chains_both_ways(spark):
    """Long chains between branching nodes, and rings of lengths that are powers of two, one less and one more."""
    pairs = [(1000, 0)] + [(i, i + 1) for i in range(37)] + [(37, 1000), (1000, 50), (50, 51), (51, 1000)]
    at = 2000
    for n in (1, 2, 3, 4, 5, 15, 16, 17):
        order = random.Random(n).sample(range(at, at + n), n)
        pairs += list(zip(order, [*order[1:], order[0]]))
        at += n
    edges = spark.createDataFrame([(a, b, 1) for a, b in pairs], "src long, dst long, n long")
    got = sorted(map(tuple, P.chains(edges).collect()))
    assert got == sorted(map(tuple, edges.coalesce(1).mapInPandas(P._chains, "src long, dst long, n long, head long, first long, pos long").collect()))
    assert len(got) == len(pairs) and {r[3:5] for r in got if r[0] < 2000} == {(1000, 0), (1000, 50)} and (36, 37, 1, 1000, 0, 37) in got


def test_long_rings_take_few_steps(spark, tmp_path, monkeypatch):
    from plexgraph.plans.text_queries import QUERIES

    n, calls, stash = 6000, [], P.stash
    spark.range(n).selectExpr("id s_suppkey", "concat('s', id) s_name", "0D s_acctbal").write.parquet(str(tmp_path / "supplier.parquet"))

    def counted(df, what):
        calls.append(what)
        assert len(calls) < 40, "a step for each edge of a ring"
        return stash(df, what)

    monkeypatch.setattr(P, "stash", counted)
    want = []
    for i in range(n):
        d, j = 1, (i * 3 + 1) % n
        while j != i and d <= 400:
            d, j = d + 1, (j * 3 + 1) % n
        want += [(i, d)] if j == i else []
    assert max(d for _, d in want) == 200
    assert sorted(map(tuple, QUERIES["cypher_long_cycles"](spark, str(tmp_path)).select("id", "steps").collect())) == want
    seeds, ring = spark.range(300).selectExpr("id as start"), spark.range(300).selectExpr("id as src", "(id * 7 + 1) % 300 as dst")
    calls.clear()
    assert P.circuits(seeds, ring, 1, values=False, one_task=0).count() == len(closed([(i, (i * 7 + 1) % 300) for i in range(300)], range(300), 1, None))


def test_cypher_cycles_keep_their_paths_where_asked(spark):
    from plexgraph.plans.catalog import GraphCatalog
    from plexgraph.plans.cypher import run

    g = GraphCatalog()
    g.add_node("N", lambda: spark.range(4).selectExpr("id", "concat('n', id) name"))
    g.add_rel("R", "N", "N", lambda: spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3)], "src long, dst long"))
    want = ["N:0 -> N:1 -> N:2 -> N:0", "N:1 -> N:2 -> N:0 -> N:1", "N:2 -> N:0 -> N:1 -> N:2"]
    assert sorted(r.p.nodes for r in run(g, "MATCH p = (a:N)-[:R*]->(a) RETURN p").collect()) == want
    assert sorted(r.r.nodes for r in run(g, "MATCH (a:N)-[r:R*]->(a) RETURN r").collect()) == want
    assert [x.nodes for x in run(g, "MATCH p = (a:N)-[:R*]->(a) RETURN collect(p) AS c").first().c] == want
    assert sorted(map(tuple, run(g, "MATCH p = (a:N)-[:R*]->(a) WHERE length(p) > 2 RETURN a.id AS id, length(p) AS n").collect())) == [(0, 3), (1, 3), (2, 3)]
    assert run(g, "MATCH p = (a:N)-[:R*]->(a) RETURN count(p) AS n").first().n == 3
