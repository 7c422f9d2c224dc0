import pytest
from pyspark.sql import functions as F

from plexgraph.cli import formatted
from plexgraph.engine import Engine
from plexgraph.plans.cypher import CypherError
from plexgraph.plans.templates import TEMPLATES
from plexgraph.plans.text_queries import SOURCES
from plexgraph.streaming.watch import watch


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, _, text in SOURCES:
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "node_modules").mkdir()
    (root / "node_modules" / "x.py").write_text("x = 1\n")
    (root / "pkg" / "large.py").write_text("#" * (1 << 20) + "#")
    return root


@pytest.fixture(scope="module")
def engine(spark, tree, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("store")))
    e.init()
    assert e.status()["nodes"] == 0
    e.update(str(tree))
    return e


def test_first_update_counts(engine):
    s = engine.statistics
    assert s["files_added"] == len(SOURCES) and s["errors"] == 1 and s["files_failed"] == 1 and engine.status()["healthy"]
    assert {r.path for r in engine.store.read("files").collect()} == {p for p, _, _ in SOURCES}


def test_edges_are_resolved_across_files(engine):
    rows = engine.query("MATCH (c:Function)-[r:CALLS]->(t:Function) RETURN c.name AS c, t.name AS t, t.file_path AS f, r.line_number AS line").collect()
    assert {(r.c, r.t, r.f) for r in rows} == {("main", "helper", "pkg/base.py"), ("area", "helper", "pkg/base.py")}
    assert {(r.a, r.b) for r in engine.query("MATCH (a:File)-[:IMPORTS]->(b:File) RETURN a.path AS a, b.path AS b").collect()} == {("pkg/use.py", "pkg/base.py"), ("src/app/a.component.ts", "src/app/b.ts"), ("src/app/b.ts", "src/app/a.component.ts")}
    assert engine.query("MATCH (c:AngularComponent)-[:USES_TEMPLATE]->(f:File) RETURN f.path AS p").collect()[0].p == "src/app/a.component.html"
    assert engine.query("MATCH (f:File)-[:USES_COMPONENT]->(c:AngularComponent) RETURN c.name AS n").count() == 1


ARGS = {
    "function_name": "helper", "class_name": "Shape", "file_name": "use.py", "path": "pkg/use.py", "part": "pkg", "min_complexity": 0, "min_lines": 1, "max_params": 1,
    "start_function": "main", "end_function": "helper", "entry_point": "main",
}


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_template_runs(engine, name):
    engine.run_template(name, **{p: ARGS[p] for p in TEMPLATES[name]["parameters"]}).collect()


def test_template_results(engine):
    one = lambda n, **p: [tuple(r) for r in engine.run_template(n, **p).collect()]
    assert one("find_subclasses", class_name="Shape") == [("Square", "pkg/base.py")]
    assert one("mutual") == [("src/app/a.component.ts", "src/app/b.ts")]
    assert ("Shape", "pkg/base.py", None) in one("abstract_classes") and one("count_complex", min_complexity=1) == [(1,)]
    callers = {c for r in one("analyze_function", function_name="helper") for c in r[1]}
    assert callers == {"area", "main"} and one("analyze_function", function_name="area")[0][3] in ("Shape", "Square")
    assert one("dependency_chain", start_function="main", end_function="helper")[0][0].length == 1
    assert one("file_dependencies", file_name="use.py") == [("base.py", "pkg/base.py")] and one("dependent_files", file_name="base.py") == [("use.py", "pkg/use.py")]
    assert one("external_dependencies") == [("abc", 1)] and one("most_imported")[0] == ("./a.component", 1)
    assert one("class_usage", class_name="B") == [("a.component.ts", "File", "src/app/a.component.ts")]
    assert one("duplicate_names") == [("helper", ["pkg/base.py", "src/app/a.component.ts"])] or {n: sorted(f) for n, f in one("duplicate_names")} == {"helper": ["pkg/base.py", "src/app/a.component.ts"]}
    assert [r[:2] for r in one("function_impact", function_name="helper")][:1] == [("area", "Function")]
    assert one("reachable_from_entry", entry_point="main") == [("helper", "pkg/base.py", 1)]
    assert one("analyze_file", file_name="use.py")[0][2] == ["base.py"] and set(one("analyze_file", file_name="use.py")[0][1]) == {"Module", "Function", "Import", "Variable"}


def test_queries_are_read_only_and_errors_are_told(engine):
    for text in ("CREATE (n:File)", "MATCH (n:File) DELETE n", "DROP TABLE File", "MATCH (n:File) SET n.name = 'x' RETURN n"):
        with pytest.raises(CypherError):
            engine.query(text)
    # Words inside strings and longer names are no write clauses.
    assert engine.query("MATCH (f:File) WHERE f.name = 'DELETE' OR f.name CONTAINS 'offset' RETURN f.name").count() == 0
    for text in ("", "MATCH (f:File)", "MATCH (f:File RETURN f", "MATCH (f:File) RETURN g.name", "MATCH (f:File) WHERE f.name = $x RETURN f.name", "MATCH (a:File), (b:Class) RETURN a.name", "MATCH (f:File) WHERE f.name =~ 'x' RETURN f"):
        with pytest.raises((CypherError, IndexError)):
            engine.query(text).count()
    assert engine.query("RETURN 1 AS x").collect()[0].x == 1 and engine.query("RETURN $v AS x", {"v": "y"}).collect()[0].x == "y"
    assert engine.query("CALL show_tables() RETURN *").filter("type = 'NODE'").count() == 27


def test_graph_tree_status_and_export(engine, tmp_path, spark):
    nodes, edges, meta = engine.graph(max_nodes=12)
    assert meta["total_nodes"] == nodes.count() and nodes.groupBy("type").count().agg(F.max("count")).first()[0] <= 3
    ids = {r.id for r in nodes.collect()}
    assert all(r.src in ids and r.dst in ids for r in edges.collect())
    assert engine.graph(search="square")[2]["total_nodes"] == 2 and engine.graph(file_filter="nothing")[2]["total_nodes"] == 0
    t = {r.path: r for r in engine.tree().collect()}
    assert t["pkg"].kind == "folder" and t["pkg"].size == sum(len(x) for p, _, x in SOURCES if p.startswith("pkg/")) and t["pkg/use.py"].parent == "pkg"
    for form in ("json", "csv"):
        engine.export(str(tmp_path / form), form)
    assert spark.read.json(str(tmp_path / "json/entities")).count() == engine.status()["nodes"]
    assert "a  b" in formatted([{"a": "1", "b": None}], "table") and len(formatted([{"a": "x" * 90}], "table").split("\n")[1]) == 50


def test_updates_equal_a_full_build(engine, tree, spark, tmp_path):
    def state(e):
        return sorted(map(str, e.store.read("edges").select("rel_type", "src", "dst").collect())), sorted(map(str, e.store.read("entities").select("id", "name", "type").collect()))

    (tree / "pkg" / "use.py").write_text("from pkg.base import helper\n\ndef main():\n    return helper(2)\n\ndef late():\n    return main()\n")
    (tree / "pkg" / "bad.py").unlink()
    (tree / "pkg" / "new.py").write_text("def fresh():\n    return late()\n")
    before = engine.store.current()
    s = engine.update(str(tree))
    assert (s["files_added"], s["files_modified"], s["files_removed"]) == (1, 1, 1) and s["version"] == before + 1
    other = Engine(spark, str(tmp_path / "other"))
    other.update(str(tree), full=True)
    assert state(engine) == state(other) and engine.orphans().count() == 0 and engine.store.read("errors").count() == 0
    assert engine.update(str(tree))["files_unchanged"] == len(SOURCES)
    assert state(engine) == state(other)


def test_an_update_writes_only_the_buckets_it_changes(spark, tmp_path):
    from plexgraph.sources.store import BUCKETS

    root = tmp_path / "many"
    root.mkdir()
    for i in range(60):
        (root / f"m{i}.py").write_text(f"def f{i}():\n    return f{(i + 1) % 60}()\n")
    e = Engine(spark, str(tmp_path / "store"))
    first = e.update(str(root))
    (root / "m7.py").write_text("def f7():\n    return f8()\n\ndef g():\n    pass\n")
    second = e.update(str(root))
    assert (second["files_modified"], second["files_unchanged"], second["entities_updated"], second["entities_added"], second["entities_removed"]) == (1, 59, 4, 0, 0)
    one, two = (e.store.manifest(s["version"])["tables"] for s in (first, second))
    new = lambda name: {b for b, f in two[name].items() if f != one[name].get(b)}
    assert len(new("entities")) == len(new("links")) == 1 and len(new("edges")) <= 3 < BUCKETS
    calls = e.query("MATCH (a:Function)-[:CALLS]->(b:Function) RETURN a.name AS a, b.name AS b").collect()
    assert {(r.a, r.b) for r in calls} == {(f"f{i}", f"f{(i + 1) % 60}") for i in range(60)}
    (root / "m8.py").unlink()
    third = e.update(str(root))
    assert third["files_removed"] == 1 and third["entities_removed"] == 3 and e.query("MATCH (a:Function)-[:CALLS]->(b:Function) RETURN a.name").count() == 58
    assert e.query("MATCH (f:ExternalFunction) RETURN f.name AS n").collect()[0].n == "f8"
    full = Engine(spark, str(tmp_path / "full"))
    full.update(str(root), full=True)
    rows = lambda x, t, *c: sorted(map(str, x.store.read(t).select(*c).collect()))
    for table, columns in (("edges", ("rel_type", "src", "dst")), ("entities", ("id", "name", "type")), ("dropped", ("rel_type", "target", "file_path")), ("links", ("source", "target"))):
        assert rows(e, table, *columns) == rows(full, table, *columns)
    assert e.store.vacuum(1) > 0 and e.store.versions() == [third["version"]] and e.status()["state"] == "healthy"
    assert rows(e, "edges", "src", "dst") == rows(full, "edges", "src", "dst")


def test_two_writers_of_one_version(spark, tmp_path):
    from plexgraph.sources.store import ConflictError, Store

    one, two = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    one.clear()
    base = two.manifest()
    row = lambda name: spark.createDataFrame([(name, name, ".py", "python", 1, 1, "h")], "path string, name string, extension string, file_type string, size long, modified_time long, hash string")
    one.write({"files": row("a")}, base)
    with pytest.raises(ConflictError):
        two.write({"files": row("b")}, base)
    assert [r.path for r in two.read("files").collect()] == ["a"] and two.versions() == [1, 2]
    two.write({"files": row("b")})
    assert [r.path for r in one.read("files").collect()] == ["b"]


def test_validation_tells_what_is_wrong(spark, tmp_path):
    import json
    import shutil

    e = Engine(spark, str(tmp_path / "s"))
    assert e.status()["state"] == "empty" and not e.store.validate()["valid"]
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    e.update(str(tmp_path / "src"))
    assert e.store.validate() == {"missing": [], "unexpected": [], "types": [], "errors": [], "valid": True} and e.status()["last_update"] > 0
    at = tmp_path / "s" / "commits" / "v00000001.json"
    told = json.loads(at.read_text())
    bucket, folder = next(iter(told["tables"]["files"].items()))
    shutil.rmtree(tmp_path / "s" / "data" / folder / "files" / f"_b={bucket}")
    spark.createDataFrame([("a", 1.5)], "path string, size double").write.parquet(str(tmp_path / "s" / "data" / folder / "files" / f"_b={bucket}"))
    told["tables"]["odd"] = told["tables"].pop("errors")
    at.unlink()
    (tmp_path / "s" / "commits" / ".v00000001.json.crc").unlink(missing_ok=True)
    at.write_text(json.dumps(told))
    other = Engine(spark, str(tmp_path / "s"))
    found = other.store.validate()
    assert not found["valid"] and found["unexpected"] == ["odd"] and "files.hash" in found["missing"] and "errors" in found["missing"] and found["types"] == ["files.size: double"]
    other.store.drop()
    assert other.store.versions() == [] and other.store.read("files").count() == 0
    with pytest.raises(ValueError):
        other.reset()


def test_bytes_that_are_not_utf8(spark, tmp_path):
    root = tmp_path / "odd"
    root.mkdir()
    (root / "bad.py").write_bytes(b"x = '\xff\xfe'\n")
    (root / "good.py").write_text("def f(): pass\n")
    (root / "b.js").write_bytes(b"// caf\xe9\nfunction g() { return 1; }\n")
    (root / "c.css").write_bytes(b".a\xff { b: c }")
    e = Engine(spark, str(tmp_path / "store"))
    s = e.update(str(root))
    assert s["errors"] == 1 and s["files_failed"] == 1 and s["files_added"] == 4
    assert [r.file_path for r in e.store.read("errors").collect()] == ["bad.py"]
    assert {r.name for r in e.store.read("entities").filter("type = 'Function'").collect()} == {"f", "g"}
    assert e.update(str(root))["files_unchanged"] == 4
    from plexgraph.sources.discover import python_files

    (root / "z.pyi").write_text("")
    assert [r.path for r in python_files(spark, str(root)).collect()] == ["bad.py", "good.py"]


def test_features_and_metadata_can_be_queried(engine, tree, spark, tmp_path):
    rows = engine.query("MATCH (f:File) WHERE f.rule_count > 0 RETURN f.path AS p, f.style_type AS t, f.scss_variables AS v, f.max_nesting_depth AS d").collect()
    assert [tuple(r) for r in rows] == [("src/app/style.scss", "scss", "w", 2)]
    assert engine.query("MATCH (f:File) WHERE f.template_type = 'angular' RETURN f.angular_directives AS d").collect()[0].d == "*ngIf"
    assert {(r.n, r.m) for r in engine.query("MATCH (c:Class) WHERE c.method_count > 0 RETURN c.name AS n, c.method_count AS m").collect()} == {("A", 2)}
    assert {r.n for r in engine.query("MATCH (c:AngularComponent) WHERE c.selector = 'app-a' RETURN c.class_name AS n").collect()} == {"A"}
    info = engine.query("CALL schema.info() RETURN *")
    assert info.filter("name = 'File' AND column = 'rule_count' AND data_type = 'bigint'").count() == 1 and info.filter("name = 'CALLS' AND type = 'REL'").count() > 2


def test_settings(tmp_path, monkeypatch):
    from plexgraph import config

    (tmp_path / "a" / "b").mkdir(parents=True)
    s = config.load(start=str(tmp_path / "a"), environment={})
    assert s.project_root == str(tmp_path / "a") and s.export.max_nodes == 1000
    s.project_root, s.parsing.max_file_size, s.storage.path = ".", 77, "graph"
    config.save(s, tmp_path / config.FILE_NAME)
    got = config.load(start=str(tmp_path / "a" / "b"), environment={"PLEXGRAPH_LOG_LEVEL": "INFO", "PLEXGRAPH_PARSING_EXCLUDE_PATTERNS": "x,y", "PLEXGRAPH_EXPORT_MAX_NODES": "5"})
    assert (got.project_root, got.storage.path, got.parsing.max_file_size) == (str(tmp_path), str(tmp_path / "graph"), 77)
    assert (got.log_level, got.parsing.exclude_patterns, got.export.max_nodes, got.export.max_edges) == ("INFO", ["x", "y"], 5, 5000)
    (tmp_path / config.FILE_NAME).write_text("parsing: {no_such: 1}")
    with pytest.raises(ValueError, match="no_such"):
        config.load(start=str(tmp_path), environment={})
    with pytest.raises(FileNotFoundError):
        config.load(tmp_path / "none.yml", environment={})


def test_external_names(spark, tmp_path):
    root = tmp_path / "ext"
    root.mkdir()
    long = "d3." + ".".join(f"part{i}" for i in range(20))
    (root / "a.ts").write_text(f"import {{ X }} from './none';\nimport y from '@scope/pkg';\nimport _ from 'lodash';\nfunction f() {{ {long}(); q.r; }}\n@Component({{ selector: 'a-b', templateUrl: './gone.html', styleUrls: ['./gone.css'] }})\nclass C {{}}\n")
    (root / "lodash.ts").write_text("export const z = 1;\n")
    e = Engine(spark, str(tmp_path / "store"))
    e.update(str(root))
    kinds = {}
    for r in e.store.read("entities").filter("ordinal = -1").collect():
        kinds.setdefault(r.type, set()).add(r.name)
    assert kinds["ExternalModule"] == {"@scope/pkg", "lodash"} and kinds["ExternalTemplate"] == {"./gone.html"} and kinds["ExternalStyle"] == {"./gone.css"} and kinds["ExternalSymbol"] == {"X"}
    assert kinds["ExternalReference"] == {"none"} and any("..." in n and len(n) <= 101 for n in kinds["ExternalFunction"])


def test_watching(spark, tree, tmp_path):
    e = Engine(spark, str(tmp_path / "watched"))
    watch(e, str(tree), str(tmp_path / "checkpoint"), once=True).awaitTermination()
    assert e.status()["tracked_files"] == len(SOURCES)
