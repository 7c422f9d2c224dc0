"""Cypher texts over the star-schema graph, and the source pipeline over a small tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexgraph.plans import extract as E
from plexgraph.plans.cypher import run
from plexgraph.plans.fixture import star_graph
from plexgraph.plans.star_queries import VIEWS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _cypher(key: str, text: str, sql: str, views: str = "", recursive: bool = False, **params) -> None:
    QUERIES[key] = lambda spark, sf: run(star_graph(spark, sf), text, params)
    head = ", ".join(VIEWS[v] for v in views.split())
    SQL[key] = (f"WITH {'RECURSIVE ' if recursive else ''}{head} " if head else "") + sql


_cypher(
    "cypher_most_called",
    "MATCH (c:Part)-[:CALLS]->(t:Part) RETURN t.id AS id, t.name AS name, COUNT(c) AS calls ORDER BY calls DESC, id LIMIT 20",
    "SELECT p_partkey AS id, p_name AS name, count(*) AS calls FROM calls JOIN part ON dst = p_partkey GROUP BY 1, 2 ORDER BY calls DESC, id LIMIT 20",
    "calls",
)
_cypher(
    "cypher_callers",
    "MATCH (c:Part)-[r:CALLS]->(:Part {name: $name}) RETURN c.id AS id, c.brand AS brand, r.line_number AS line",
    "SELECT c.p_partkey AS id, c.p_brand AS brand, CAST(line_number AS BIGINT) AS line FROM calls JOIN part t ON dst = t.p_partkey JOIN part c ON src = c.p_partkey WHERE t.p_name = 'cold widget'",
    "calls",
    name="cold widget",
)
_cypher(
    "cypher_unused",
    "MATCH (f:Part) WHERE NOT ()-[:CALLS]->(f) AND f.name <> 'cold widget' AND NOT f.name STARTS WITH 'red' RETURN f.id AS id",
    "SELECT p_partkey AS id FROM part WHERE NOT EXISTS (SELECT 1 FROM calls WHERE dst = p_partkey) AND p_name <> 'cold widget' AND NOT starts_with(p_name, 'red')",
    "calls",
)
_cypher(
    "cypher_impact",
    "MATCH path = (c:Part)-[:CALLS*1..3]->(t:Part {name: $name}) RETURN DISTINCT c.id AS id, length(path) AS depth",
    """, w AS (SELECT src AS node, 1 AS depth FROM calls JOIN part ON dst = p_partkey WHERE p_name = 'cold widget'
  UNION SELECT c.src, w.depth + 1 FROM w JOIN calls c ON c.dst = w.node WHERE w.depth < 3) SELECT DISTINCT node AS id, CAST(depth AS BIGINT) AS depth FROM w""",
    "calls",
    True,
    name="cold widget",
)
_cypher(
    "cypher_reachable",
    "MATCH p = (a:Part {id: 200})-[:INHERITS*]->(b:Part) RETURN b.id AS id, MIN(length(p)) AS distance",
    """, w AS (SELECT dst AS node, 1 AS d FROM inherits WHERE src = 200 UNION SELECT i.dst, w.d + 1 FROM w JOIN inherits i ON i.src = w.node)
SELECT node AS id, CAST(min(d) AS BIGINT) AS distance FROM w JOIN part ON p_partkey = node GROUP BY node""",
    "inherits",
    True,
)
_cypher(
    "cypher_cycles",
    "MATCH path = (s:Supplier)-[:IMPORTS*2..10]->(s) WHERE length(path) > 2 RETURN s.id AS id, length(path) AS steps",
    """, w AS (SELECT src AS start, dst AS node, 1 AS depth FROM imports UNION SELECT w.start, i.dst, w.depth + 1 FROM w JOIN imports i ON i.src = w.node WHERE w.depth < 10)
SELECT start AS id, CAST(depth AS BIGINT) AS steps FROM w WHERE start = node AND depth > 2""",
    "imports",
    True,
)
_cypher(
    "cypher_long_cycles",
    "MATCH path = (s:Supplier)-[:IMPORTS*]->(s) RETURN s.id AS id, length(path) AS steps",
    """, w AS (SELECT src AS start, dst AS node, 1 AS depth FROM imports
  UNION ALL SELECT w.start, i.dst, w.depth + 1 FROM w JOIN imports i ON i.src = w.node WHERE w.node <> w.start AND w.depth < (SELECT count(*) FROM supplier))
SELECT start AS id, CAST(depth AS BIGINT) AS steps FROM w WHERE start = node""",
    "imports",
    True,
)
_cypher(
    "cypher_long_paths",
    "MATCH p = (s:Supplier {id: 1})-[:IMPORTS*]->(t:Supplier) RETURN t.id AS id, length(p) AS steps, p AS route",
    """, w AS (SELECT dst AS node, 1 AS depth, [src, dst] AS seen FROM imports WHERE src = 1 AND dst <> 1
  UNION ALL SELECT i.dst, w.depth + 1, list_append(w.seen, i.dst) FROM w JOIN imports i ON i.src = w.node WHERE NOT list_contains(w.seen, i.dst))
SELECT node AS id, CAST(depth AS BIGINT) AS steps, array_to_string(list_transform(seen, lambda x: 'Supplier:' || x), ' -> ') AS route FROM w""",
    "imports",
    True,
)
_long_paths = QUERIES["cypher_long_paths"]
QUERIES["cypher_long_paths"] = lambda spark, sf: _long_paths(spark, sf).withColumn("route", F.col("route.nodes"))
_cypher(
    "cypher_optional",
    "MATCH (f:Part) OPTIONAL MATCH (c:Part)-[:CALLS]->(f) OPTIONAL MATCH (s:Part)-[:INHERITS]->(f) RETURN f.id AS id, COUNT(DISTINCT c) AS callers, COUNT(DISTINCT s) AS children",
    """SELECT p_partkey AS id, count(DISTINCT c.src) AS callers, count(DISTINCT i.src) AS children FROM part
LEFT JOIN calls c ON c.dst = p_partkey LEFT JOIN inherits i ON i.dst = p_partkey GROUP BY 1""",
    "calls inherits",
)
_cypher(
    "cypher_duplicate_names",
    "MATCH (a:Part), (b:Part) WHERE a.name = b.name AND a.brand <> b.brand AND a.id < 40 RETURN a.name AS name, a.id AS id, COUNT(DISTINCT b) AS others",
    "SELECT a.p_name AS name, a.p_partkey AS id, count(DISTINCT b.p_partkey) AS others FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand <> b.p_brand WHERE a.p_partkey < 40 GROUP BY 1, 2",
)
_cypher(
    "cypher_any_node_properties",
    "MATCH (n) WHERE n.balance > 9000 OR n.size = 7 RETURN labels(n)[0] AS kind, n.name AS name, n.balance AS balance, n.size AS size",
    """SELECT 'Customer' AS kind, c_name AS name, c_acctbal AS balance, CAST(NULL AS BIGINT) AS size FROM customer WHERE c_acctbal > 9000
UNION ALL SELECT 'Supplier', s_name, s_acctbal, NULL FROM supplier WHERE s_acctbal > 9000 UNION ALL SELECT 'Part', p_name, NULL, CAST(p_size AS BIGINT) FROM part WHERE p_size = 7""",
)
_cypher(
    "cypher_contains",
    "MATCH (n:Nation)-[:CONTAINS]->(x) RETURN n.name AS nation, labels(x)[0] AS kind, COUNT(*) AS n",
    """SELECT n_name AS nation, kind, count(*) AS n FROM nation JOIN (SELECT c_nationkey k, 'Customer' kind FROM customer UNION ALL SELECT s_nationkey, 'Supplier' FROM supplier) x ON k = n_nationkey GROUP BY 1, 2""",
)
_cypher(
    "cypher_degree",
    "MATCH (f:Part) WITH f, count{(f)-[:CALLS]->()} AS made, count{()-[:CALLS]->(f)} AS had WHERE made + had > 2 RETURN f.id AS id, made + had AS degree ORDER BY degree DESC, id LIMIT 10",
    """SELECT id, degree FROM (SELECT p_partkey AS id, (SELECT count(*) FROM calls WHERE src = p_partkey) + (SELECT count(*) FROM calls WHERE dst = p_partkey) AS degree FROM part) x
WHERE degree > 2 ORDER BY degree DESC, id LIMIT 10""",
    "calls",
)
_cypher(
    "cypher_with_pipeline",
    "MATCH (f:Part) WITH f.name AS name, COUNT(DISTINCT f.brand) AS brands WHERE brands > 1 RETURN name, brands",
    "SELECT p_name AS name, count(DISTINCT p_brand) AS brands FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1",
)
_cypher(
    "cypher_any_edge",
    "MATCH ()-[r]->() RETURN type(r) AS kind, COUNT(r) AS n",
    "SELECT t AS kind, count(*) AS n FROM (SELECT t FROM contains UNION ALL SELECT 'CALLS' FROM calls UNION ALL SELECT 'INHERITS' FROM inherits UNION ALL SELECT 'IMPORTS' FROM imports) x GROUP BY 1",
    "contains calls inherits imports",
)

#: A small tree in every language.
SOURCES = [
    ("pkg/base.py", "python", "from abc import ABC\n\nclass Shape(ABC):\n    def area(self):\n        return 0\n\nclass Square(Shape):\n    def area(self, side=1):\n        return helper(side) if side and side > 0 else 0\n\ndef helper(x):\n    return x\n"),
    ("pkg/use.py", "python", "from pkg.base import Square, helper\n\nLIMIT = 3\n\ndef main():\n    s = Square()\n    return helper(LIMIT)\n"),
    ("pkg/bad.py", "python", "def broken(:\n"),
    ("src/app/a.component.ts", "angular", "import { B } from './b';\n@Component({ selector: 'app-a', templateUrl: './a.component.html' })\nexport class A extends B {\n  run(): void { this.go(); helper(1); }\n  go() { }\n}\nexport function helper(x) { return x; }\n"),
    ("src/app/b.ts", "typescript", "import { A } from './a.component';\nexport class B { }\nexport const f = (x) => x + 1;\n"),
    ("src/app/a.component.html", "angular_template", "<app-a *ngIf=\"ok\"></app-a>{{ value }}\n"),
    ("src/app/style.scss", "css", "@use './vars';\n$w: 1px;\n.a { .b { width: $w } }\n"),
]


def _parsed(spark) -> DataFrame:
    return E.parse_files(spark.createDataFrame(SOURCES, "path string, file_type string, text string"))


def source_entities(spark, sf) -> DataFrame:
    return E.entities_of(_parsed(spark)).select("type", "name", "file_path", "line_start", "line_end")


def source_edges(spark, sf) -> DataFrame:
    from plexgraph.storage import stash

    p = stash(_parsed(spark), "parsed")
    entities = E.entities_of(p)
    edges, _ = E.resolve_links(E.links_of(p), entities)
    names = entities.select("id", "name")
    out = edges.join(names.select(F.col("id").alias("src"), F.col("name").alias("source")), "src").join(names.select(F.col("id").alias("dst"), F.col("name").alias("target")), "dst")
    return out.select("rel_type", "from_label", "source", "to_label", "target")


def source_errors(spark, sf) -> DataFrame:
    return _parsed(spark).filter("kind = 'error'").select("file_path", "message")


def source_styles(spark, sf) -> DataFrame:
    from plexgraph.functions.text import style_features

    rows = spark.createDataFrame(SOURCES, "path string, file_type string, text string").filter("path LIKE '%.scss'")
    return rows.select("path", *[(F.array_join(c, ",") if n in _LISTS else c.cast("string")).alias(n) for n, c in style_features(F.col("text"), F.col("path")).items()])


def source_features(spark, sf) -> DataFrame:
    """What templates and style sheets tell of themselves, asked of the File entities."""
    props = ("language", "framework", "template_type", "angular_directives", "custom_components", "interpolations", "style_type", "selectors", "rule_count", "imports", "scss_variables", "max_nesting_depth")
    rows = E.entities_of(_parsed(spark)).filter("type = 'File'")
    found = rows.select("file_path", *[F.coalesce(F.try_element_at("props", F.lit(p)), F.lit("")).alias(p) for p in props])
    return found.filter("language <> ''")


def page_entities(spark, sf) -> DataFrame:
    """The HTML parser over the whole pages table."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    files = pages.select(F.col("page_id").cast("string").alias("path"), F.lit("html").alias("file_type"), F.coalesce("html", F.lit("")).alias("text"))
    return E.entities_of(E.parse_files(files)).select("type", "name", "file_path", "line_start", "line_end")


_LISTS = {"directives", "components", "material_components", "selectors", "imports", "variables", "mixins", "functions", "material"}


def _plain(features: dict) -> list:
    return [(F.array_join(c, ",") if n in _LISTS else c.cast("long") if n not in ("is_angular", "css_type") else c).alias(n) for n, c in features.items()]


def page_features(spark, sf) -> DataFrame:
    """All template features over the whole pages table; lists as text."""
    from plexgraph.functions.text import html_features

    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", *_plain(html_features(F.coalesce("html", F.lit("")))))


def page_styles(spark, sf) -> DataFrame:
    """All style features over the whole pages table, each page taken as an SCSS text; lists as text."""
    from plexgraph.functions.text import style_features

    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", *_plain(style_features(F.coalesce("html", F.lit("")), F.concat(F.col("page_id").cast("string"), F.lit(".scss")))))


def document_files(spark, sf) -> DataFrame:
    """File facts of the whole documents table, each document taken as a text file."""
    from plexgraph.functions.text import file_info

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return file_info(docs.select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".tar.txt")).alias("path"), "text"))


QUERIES |= {f.__name__: f for f in (source_entities, source_edges, source_errors, source_styles, source_features, page_entities, page_features, page_styles, document_files)}
SQL["source_errors"] = "SELECT 'pkg/bad.py' AS file_path, 'SyntaxError: invalid syntax (<unknown>, line 1)' AS message"


def _distinct(pattern: str, group: int = 1, text: str = "t") -> str:
    return f"array_to_string(list_sort(list_distinct(regexp_extract_all({text}, '{pattern}', {group}))), ',')"


SQL["page_entities"] = """
SELECT 'File' AS type, CAST(page_id AS VARCHAR) AS name, CAST(page_id AS VARCHAR) AS file_path, CAST(1 AS BIGINT) AS line_start,
       CAST(length(t) - length(replace(t, chr(10), '')) + 1 AS BIGINT) AS line_end
FROM (SELECT page_id, coalesce(html, '') AS t FROM pages) p"""
SQL["page_features"] = rf"""
SELECT page_id, regexp_matches(t, '\*ng[A-Z][a-zA-Z]*|\[.*?\]|\(.*?\)|\{{\{{.*?\}}\}}|#[a-zA-Z][a-zA-Z0-9]*|mat-[a-z-]+|app-[a-z-]+') AS is_angular,
       {_distinct(r"\*ng[A-Z][a-zA-Z]*", 0)} AS directives, {_distinct("<(app-[a-z-]+)")} AS components, {_distinct("<(mat-[a-z-]+)")} AS material_components,
       CAST(len(regexp_extract_all(t, '\[.*?\]')) AS BIGINT) AS property_bindings, CAST(len(regexp_extract_all(t, '\(.*?\)')) AS BIGINT) AS event_bindings,
       CAST(len(regexp_extract_all(t, '\{{\{{.*?\}}\}}')) AS BIGINT) AS interpolations
FROM (SELECT page_id, coalesce(html, '') AS t FROM pages) p"""
_SELECTOR = r"([.#]?[a-zA-Z][a-zA-Z0-9_-]*(?:\s*[>+~]\s*[.#]?[a-zA-Z][a-zA-Z0-9_-]*)*)\s*\{"
SQL["page_styles"] = rf"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, regexp_replace(coalesce(html, ''), '(?s)/\*.*?\*/', '', 'g') AS bare FROM pages),
c AS (SELECT page_id, regexp_replace(t, '[^{{}}]', '', 'g') AS b FROM p),
s AS (SELECT page_id, i, sum(CASE b[i] WHEN '{{' THEN 1 ELSE -1 END) OVER (PARTITION BY page_id ORDER BY i) AS h FROM (SELECT page_id, b, unnest(range(1, len(b) + 1)) AS i FROM c)),
f AS (SELECT page_id, h - least(0, min(h) OVER (PARTITION BY page_id ORDER BY i)) AS d FROM s),
n AS (SELECT page_id, max(d) AS deep FROM f GROUP BY 1),
k AS (SELECT *, list_sort(list_distinct(regexp_extract_all(bare, '{_SELECTOR}', 1))) AS sel, regexp_matches(t, ':host|::ng-deep|@use [''"]@angular|mat-[a-z-]+') AS ng FROM p)
SELECT k.page_id, 'scss' AS css_type, ng AS is_angular, CAST(len(sel) AS BIGINT) AS selector_count, array_to_string(sel[1:20], ',') AS selectors,
       CAST(len(regexp_extract_all(t, '\{{[^}}]*\}}')) AS BIGINT) AS rules,
       array_to_string(list_concat(list_concat(regexp_extract_all(t, '@import\s+[''"]([^''"]+)[''"]', 1), regexp_extract_all(t, '@use\s+[''"]([^''"]+)[''"]', 1)), regexp_extract_all(t, '@forward\s+[''"]([^''"]+)[''"]', 1)), ',') AS imports,
       {_distinct(r"\$([a-zA-Z][a-zA-Z0-9_-]*)")} AS variables, {_distinct(r"@mixin\s+([a-zA-Z][a-zA-Z0-9_-]*)")} AS mixins, {_distinct(r"@function\s+([a-zA-Z][a-zA-Z0-9_-]*)")} AS functions,
       CAST(coalesce(deep, 0) AS BIGINT) AS max_nesting, CAST(CASE WHEN ng THEN len(regexp_extract_all(t, ':host')) ELSE 0 END AS BIGINT) AS host_rules,
       CAST(CASE WHEN ng THEN len(regexp_extract_all(t, '::ng-deep')) ELSE 0 END AS BIGINT) AS deep_rules, CASE WHEN ng THEN {_distinct("mat-[a-z-]+", 0)} ELSE '' END AS material
FROM k LEFT JOIN n ON k.page_id = n.page_id"""
SQL["document_files"] = r"""
SELECT 'docs/' || doc_id || '.tar.txt' AS path, doc_id || '.tar.txt' AS name, doc_id || '.tar' AS stem, '.txt' AS extension, CAST(strlen(t) AS BIGINT) AS size,
       CAST(len(string_split(t, chr(10))) AS BIGINT) AS total_lines,
       CAST(len(list_filter(string_split(t, chr(10)), lambda x: trim(x, ' ') <> '' AND NOT starts_with(trim(x, ' '), '#'))) AS BIGINT) AS lines_of_code, sha256(t) AS hash
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) d"""

# What the small tree holds, read off its texts by hand.
_EXPECTED = {
    "source_entities": (
        "type name file_path line_start line_end",
        [
            ("AngularComponent", "app-a", "src/app/a.component.ts", 2, 2),
            ("ArrowFunction", "f", "src/app/b.ts", 3, 3),
            ("Class", "A", "src/app/a.component.ts", 3, 6),
            ("Class", "B", "src/app/b.ts", 2, 2),
            ("Class", "Shape", "pkg/base.py", 3, 5),
            ("Class", "Square", "pkg/base.py", 7, 9),
            ("Export", "A", "src/app/a.component.ts", 3, 3),
            ("Export", "B", "src/app/b.ts", 2, 2),
            ("Export", "f", "src/app/b.ts", 3, 3),
            ("Export", "helper", "src/app/a.component.ts", 7, 7),
            ("File", "a.component.html", "src/app/a.component.html", 1, 2),
            ("File", "a.component.ts", "src/app/a.component.ts", 1, 8),
            ("File", "b.ts", "src/app/b.ts", 1, 4),
            ("File", "base.py", "pkg/base.py", 1, 13),
            ("File", "style.scss", "src/app/style.scss", 1, 4),
            ("File", "use.py", "pkg/use.py", 1, 8),
            ("Function", "area", "pkg/base.py", 4, 5),
            ("Function", "area", "pkg/base.py", 8, 9),
            ("Function", "helper", "pkg/base.py", 11, 12),
            ("Function", "helper", "src/app/a.component.ts", 7, 7),
            ("Function", "main", "pkg/use.py", 5, 7),
            ("Import", "./a.component", "src/app/b.ts", 1, 1),
            ("Import", "./b", "src/app/a.component.ts", 1, 1),
            ("Import", "ABC", "pkg/base.py", 1, 1),
            ("Import", "Square", "pkg/use.py", 1, 1),
            ("Import", "helper", "pkg/use.py", 1, 1),
            ("Method", "go", "src/app/a.component.ts", 5, 5),
            ("Method", "run", "src/app/a.component.ts", 4, 4),
            ("Module", "base", "pkg/base.py", 1, 13),
            ("Module", "use", "pkg/use.py", 1, 8),
            ("Variable", "LIMIT", "pkg/use.py", 3, 3),
            ("Variable", "f", "src/app/b.ts", 3, 3),
            ("Variable", "s", "pkg/use.py", 6, 6),
        ],
    ),
    "source_edges": (
        "rel_type from_label source to_label target",
        [
            ("CALLS", "Function", "area", "Function", "helper"),
            ("CALLS", "Function", "main", "Function", "helper"),
            ("CALLS", "Method", "run", "Function", "helper"),
            ("CALLS", "Method", "run", "Method", "go"),
            ("CLASS_CONTAINS_FUNCTION", "Class", "Shape", "Function", "area"),
            ("CLASS_CONTAINS_FUNCTION", "Class", "Square", "Function", "area"),
            ("CLASS_CONTAINS_METHOD", "Class", "A", "Method", "go"),
            ("CLASS_CONTAINS_METHOD", "Class", "A", "Method", "run"),
            ("EXPORTS", "File", "a.component.ts", "Export", "A"),
            ("EXPORTS", "File", "a.component.ts", "Export", "helper"),
            ("EXPORTS", "File", "b.ts", "Export", "B"),
            ("EXPORTS", "File", "b.ts", "Export", "f"),
            ("EXTENDS", "Class", "A", "Class", "B"),
            ("FILE_CONTAINS_ANGULARCOMPONENT", "File", "a.component.ts", "AngularComponent", "app-a"),
            ("FILE_CONTAINS_ARROWFUNCTION", "File", "b.ts", "ArrowFunction", "f"),
            ("FILE_CONTAINS_CLASS", "File", "a.component.ts", "Class", "A"),
            ("FILE_CONTAINS_CLASS", "File", "b.ts", "Class", "B"),
            ("FILE_CONTAINS_CLASS", "File", "base.py", "Class", "Shape"),
            ("FILE_CONTAINS_CLASS", "File", "base.py", "Class", "Square"),
            ("FILE_CONTAINS_EXPORT", "File", "a.component.ts", "Export", "A"),
            ("FILE_CONTAINS_EXPORT", "File", "a.component.ts", "Export", "helper"),
            ("FILE_CONTAINS_EXPORT", "File", "b.ts", "Export", "B"),
            ("FILE_CONTAINS_EXPORT", "File", "b.ts", "Export", "f"),
            ("FILE_CONTAINS_FUNCTION", "File", "a.component.ts", "Function", "helper"),
            ("FILE_CONTAINS_FUNCTION", "File", "base.py", "Function", "helper"),
            ("FILE_CONTAINS_FUNCTION", "File", "use.py", "Function", "main"),
            ("FILE_CONTAINS_IMPORT", "File", "a.component.ts", "Import", "./b"),
            ("FILE_CONTAINS_IMPORT", "File", "b.ts", "Import", "./a.component"),
            ("FILE_CONTAINS_IMPORT", "File", "base.py", "Import", "ABC"),
            ("FILE_CONTAINS_IMPORT", "File", "use.py", "Import", "Square"),
            ("FILE_CONTAINS_IMPORT", "File", "use.py", "Import", "helper"),
            ("FILE_CONTAINS_METHOD", "File", "a.component.ts", "Method", "go"),
            ("FILE_CONTAINS_METHOD", "File", "a.component.ts", "Method", "run"),
            ("FILE_CONTAINS_MODULE", "File", "base.py", "Module", "base"),
            ("FILE_CONTAINS_MODULE", "File", "use.py", "Module", "use"),
            ("FILE_CONTAINS_VARIABLE", "File", "b.ts", "Variable", "f"),
            ("FILE_CONTAINS_VARIABLE", "File", "use.py", "Variable", "LIMIT"),
            ("FUNCTION_CONTAINS_VARIABLE", "Function", "main", "Variable", "s"),
            ("IMPORTS", "File", "a.component.ts", "File", "b.ts"),
            ("IMPORTS", "Import", "./b", "File", "b.ts"),
            ("IMPORTS", "Import", "./a.component", "File", "a.component.ts"),
            ("IMPORTS", "Import", "Square", "File", "base.py"),
            ("IMPORTS", "Import", "helper", "File", "base.py"),
            ("IMPORTS", "File", "b.ts", "File", "a.component.ts"),
            ("IMPORTS", "File", "use.py", "File", "base.py"),
            ("IMPORTS", "File", "use.py", "File", "base.py"),
            ("INHERITS", "Class", "A", "Class", "B"),
            ("INHERITS", "Class", "Square", "Class", "Shape"),
            ("MODULE_CONTAINS_CLASS", "Module", "base", "Class", "Shape"),
            ("MODULE_CONTAINS_CLASS", "Module", "base", "Class", "Square"),
            ("MODULE_CONTAINS_FUNCTION", "Module", "base", "Function", "helper"),
            ("MODULE_CONTAINS_FUNCTION", "Module", "use", "Function", "main"),
            ("MODULE_CONTAINS_VARIABLE", "Module", "use", "Variable", "LIMIT"),
            ("USES", "File", "a.component.ts", "Class", "B"),
            ("USES", "File", "b.ts", "Class", "A"),
            ("USES_COMPONENT", "File", "a.component.html", "AngularComponent", "app-a"),
            ("USES_TEMPLATE", "AngularComponent", "app-a", "File", "a.component.html"),
        ],
    ),
    "source_styles": (
        "path css_type is_angular selector_count selectors rules imports variables mixins functions max_nesting host_rules deep_rules material",
        [
            ("src/app/style.scss", "scss", "false", "2", ".a,.b", "1", "./vars", "w", "", "", "2", "0", "0", ""),
        ],
    ),
    "source_features": (
        "file_path language framework template_type angular_directives custom_components interpolations style_type selectors rule_count imports scss_variables max_nesting_depth",
        [
            ("src/app/a.component.html", "html", "angular", "angular", "*ngIf", "app-a", "1", "", "", "", "", "", ""),
            ("src/app/style.scss", "scss", "", "", "", "", "", "scss", ".a,.b", "1", "./vars", "w", "2"),
        ],
    ),
}


def _rows(name: str) -> str:
    columns, rows = _EXPECTED[name]

    def value(x) -> str:
        return f"CAST({x} AS BIGINT)" if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(value, r)) + ')' for r in rows)}) t({', '.join(columns.split())})"


SQL |= {name: _rows(name) for name in _EXPECTED}
