"""Queries over the star-schema graph, each built from the pattern operators, with the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexgraph.functions import text as X
from plexgraph.operators import patterns as P
from plexgraph.operators import view as V
from plexgraph.plans.fixture import star_graph

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: The CTEs that SQL needs for the derived relationships.
VIEWS = {
    "calls": """calls AS (SELECT src, dst, line_number FROM (
  SELECT l_partkey src, l_linenumber line_number, l_quantity q, l_returnflag f,
         lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) dst
  FROM lineitem) x WHERE dst IS NOT NULL AND q >= 45 AND f = 'R')""",
    "inherits": "inherits AS (SELECT p_partkey src, CAST(floor(p_partkey / 2) AS BIGINT) dst FROM part WHERE p_partkey > 0)",
    "imports": "imports AS (SELECT s_suppkey src, (s_suppkey * 3 + 1) % (SELECT count(*) FROM supplier) dst FROM supplier)",
    "contains": """contains AS (
  SELECT 'REGION_CONTAINS_NATION' t, 'Region:' || n_regionkey src, 'Nation:' || n_nationkey dst FROM nation
  UNION ALL SELECT 'NATION_CONTAINS_CUSTOMER', 'Nation:' || c_nationkey, 'Customer:' || c_custkey FROM customer
  UNION ALL SELECT 'NATION_CONTAINS_SUPPLIER', 'Nation:' || s_nationkey, 'Supplier:' || s_suppkey FROM supplier
  UNION ALL SELECT 'CUSTOMER_CONTAINS_ORDER', 'Customer:' || o_custkey, 'Order:' || o_orderkey FROM orders
  UNION ALL SELECT 'ORDER_CONTAINS_PART', 'Order:' || l_orderkey, 'Part:' || l_partkey FROM lineitem)""",
    "nodes": """nodes AS (
  SELECT 'Region' AS label, CAST(r_regionkey AS BIGINT) id, r_name AS name FROM region UNION ALL SELECT 'Nation', n_nationkey, n_name FROM nation
  UNION ALL SELECT 'Customer', c_custkey, c_name FROM customer UNION ALL SELECT 'Supplier', s_suppkey, s_name FROM supplier
  UNION ALL SELECT 'Part', p_partkey, p_name FROM part UNION ALL SELECT 'Order', o_orderkey, o_orderpriority FROM orders)""",
}


def query(name: str, sql: str | None = None, views: str = "", recursive: bool = False):
    def keep(f):
        QUERIES[name] = f
        if sql:
            head = ", ".join(VIEWS[v] for v in views.split())
            SQL[name] = (f"WITH {'RECURSIVE ' if recursive else ''}{head}" + (" " if sql.lstrip().startswith(",") else "\n") if head or recursive else "") + sql
        return f

    return keep


def _parts(g) -> DataFrame:
    return g.node("Part").select("id", "name", "size")


@query("most_called", "SELECT p_partkey AS id, p_name AS name, count(*) AS call_count FROM calls JOIN part ON dst = p_partkey GROUP BY 1, 2 ORDER BY call_count DESC, id LIMIT 20", "calls")
def most_called(spark: SparkSession, sf: str) -> DataFrame:
    g = star_graph(spark, sf)
    # Counted before the join: the shuffle and the join see a row for each target.
    counts = g.edges("CALLS").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("call_count"))
    return P.top_k(counts.join(_parts(g).select("id", "name"), "id"), [F.desc("call_count"), F.asc("id")], 20).select("id", "name", "call_count")


@query("find_callers", "SELECT c.p_name AS caller, c.p_partkey AS caller_id, line_number FROM calls JOIN part t ON dst = t.p_partkey JOIN part c ON src = c.p_partkey WHERE t.p_name = 'cold widget'", "calls")
def find_callers(spark, sf):
    g = star_graph(spark, sf)
    targets = g.node("Part").filter(F.col("name") == "cold widget").select(F.col("id").alias("t"))
    hops = P.expand(targets, g.edges("CALLS"), "t", "caller_id", reverse=True, props={"line_number": "line_number"})
    return hops.join(g.node("Part").select(F.col("id").alias("caller_id"), F.col("name").alias("caller")), "caller_id").select("caller", "caller_id", F.col("line_number").cast("long"))


SQL["find_callers"] = SQL["find_callers"].replace("line_number FROM calls JOIN", "CAST(line_number AS BIGINT) AS line_number FROM calls JOIN")


@query("find_callers_distinct", "SELECT DISTINCT c.p_name AS caller, c.p_brand AS brand FROM calls JOIN part t ON dst = t.p_partkey JOIN part c ON src = c.p_partkey WHERE t.p_name = 'cold widget'", "calls")
def find_callers_distinct(spark, sf):
    g = star_graph(spark, sf)
    targets = g.node("Part").filter(F.col("name") == "cold widget").select(F.col("id").alias("t"))
    callers = P.expand(targets, g.edges("CALLS"), "t", "id", reverse=True).select("id").distinct()
    return callers.join(g.node("Part"), "id").select(F.col("name").alias("caller"), "brand").distinct()


@query("unused_nodes", "SELECT p_partkey AS id, p_name AS name FROM part WHERE NOT EXISTS (SELECT 1 FROM calls WHERE dst = p_partkey) AND p_name <> 'cold widget' AND NOT starts_with(p_name, 'red')", "calls")
def unused_nodes(spark, sf):
    g = star_graph(spark, sf)
    kept = g.node("Part").filter((F.col("name") != "cold widget") & ~F.col("name").startswith("red"))
    return P.anti(kept, g.edges("CALLS"), incoming=True).select("id", "name")


@query("calls_something", "SELECT p_partkey AS id, p_name AS name FROM part WHERE EXISTS (SELECT 1 FROM calls WHERE src = p_partkey)", "calls")
def calls_something(spark, sf):
    g = star_graph(spark, sf)
    return P.semi(_parts(g).select("id", "name"), g.edges("CALLS"))


@query("self_calls", "SELECT p_partkey AS id, p_name AS name FROM calls JOIN part ON src = p_partkey WHERE src = dst", "calls")
def self_calls(spark, sf):
    g = star_graph(spark, sf)
    return g.edges("CALLS").filter("src = dst").select(F.col("src").alias("id")).join(_parts(g).select("id", "name"), "id")


@query("leaf_nodes", "SELECT p_partkey AS id, p_name AS name FROM part WHERE NOT EXISTS (SELECT 1 FROM inherits WHERE dst = p_partkey)", "inherits")
def leaf_nodes(spark, sf):
    g = star_graph(spark, sf)
    return P.anti(_parts(g).select("id", "name"), g.edges("INHERITS"), incoming=True)


@query(
    "impact_3hop",
    """, w AS (SELECT src AS node, 1 AS depth FROM calls JOIN part ON dst = p_partkey WHERE p_name = 'cold widget'
  UNION SELECT c.src, w.depth + 1 FROM w JOIN calls c ON c.dst = w.node WHERE w.depth < 3)
SELECT DISTINCT node AS id, CAST(depth AS BIGINT) AS depth FROM w""",
    "calls",
    True,
)
def impact_3hop(spark, sf):
    g = star_graph(spark, sf)
    seeds = g.node("Part").filter(F.col("name") == "cold widget").select(F.col("id").alias("start"))
    back = P.stash(g.edges("CALLS").select(F.col("dst").alias("src"), F.col("src").alias("dst")), "impact-edges")
    return P.walks(seeds, back, 1, 3, distinct=True).select(F.col("node").alias("id"), "depth").distinct()


@query(
    "all_subclasses",
    """, w AS (SELECT src AS node FROM inherits WHERE dst = 5 UNION SELECT i.src FROM w JOIN inherits i ON i.dst = w.node)
SELECT node AS id, p_name AS name FROM w JOIN part ON p_partkey = node""",
    "inherits",
    True,
)
def all_subclasses(spark, sf):
    g = star_graph(spark, sf)
    seeds = g.node("Part").filter("id = 5").select("id")
    found = P.reach(seeds, g.edges("INHERITS"), reverse=True).filter("distance > 0").select(F.col("node").alias("id"))
    return found.join(_parts(g).select("id", "name"), "id")


@query(
    "hierarchy_paths",
    """, w AS (SELECT src AS start, dst AS node, 1 AS depth, src || '>' || dst AS path FROM inherits
  UNION ALL SELECT w.start, i.dst, w.depth + 1, w.path || '>' || i.dst FROM w JOIN inherits i ON i.src = w.node WHERE w.depth < 30)
SELECT start AS start_id, node AS id, CAST(depth AS BIGINT) AS depth, path FROM w""",
    "inherits",
    True,
)
def hierarchy_paths(spark, sf):
    g = star_graph(spark, sf)
    e = P.stash(g.edges("INHERITS"), "hierarchy-edges")
    seeds = e.select(F.col("src").alias("start")).distinct()
    return P.paths(seeds, e, 1, 30).select(F.col("start").alias("start_id"), F.col("node").alias("id"), "depth", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(
    "cycles_le10",
    """, w AS (SELECT src AS start, dst AS node, 1 AS depth FROM imports UNION SELECT w.start, i.dst, w.depth + 1 FROM w JOIN imports i ON i.src = w.node WHERE w.depth < 10)
SELECT start AS node, CAST(depth AS BIGINT) AS length FROM w WHERE start = node AND depth > 2""",
    "imports",
    True,
)
def cycles_le10(spark, sf):
    g = star_graph(spark, sf)
    return P.cycles(P.stash(g.edges("IMPORTS"), "import-edges"), 3, 10)


_HUB = "(SELECT src FROM calls GROUP BY src ORDER BY count(DISTINCT dst) DESC, src LIMIT 1)"


def _hub(g) -> DataFrame:
    outs = g.edges("CALLS").groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("n"))
    return P.top_k(outs, [F.desc("n"), F.asc("id")], 1).select("id")


@query(
    "reachable_min_dist",
    f""", e AS (SELECT DISTINCT src, dst FROM calls), w AS (SELECT src AS node, 0 AS d FROM {_HUB} UNION SELECT e.dst, w.d + 1 FROM w JOIN e ON e.src = w.node WHERE w.d < 60)
SELECT node AS id, CAST(min(d) AS BIGINT) AS distance FROM w GROUP BY node""",
    "calls",
    True,
)
def reachable_min_dist(spark, sf):
    g = star_graph(spark, sf)
    return P.reach(_hub(g), g.edges("CALLS")).select(F.col("node").alias("id"), "distance")


@query(
    "dependency_chain",
    """, w AS (SELECT src AS node, 0 AS depth, CAST(src AS VARCHAR) AS path FROM (SELECT 200 AS src) UNION ALL
  SELECT i.dst, w.depth + 1, w.path || '>' || i.dst FROM w JOIN inherits i ON i.src = w.node WHERE w.depth < 5)
SELECT CAST(depth AS BIGINT) AS depth, path FROM w WHERE node = 12 ORDER BY depth, path LIMIT 5""",
    "inherits",
    True,
)
def dependency_chain(spark, sf):
    g = star_graph(spark, sf)
    seeds = g.node("Part").filter("id = 200").select(F.col("id").alias("start"))
    found = P.paths(seeds, P.stash(g.edges("INHERITS"), "chain-edges"), 1, 5).filter("node = 12")
    return P.top_k(found.select("depth", F.array_join(F.col("path").cast("array<string>"), ">").alias("path")), [F.asc("depth"), F.asc("path")], 5)


@query(
    "optional_degree_profile",
    """SELECT p_partkey AS id, coalesce(a.n, 0) AS callers, coalesce(b.n, 0) AS targets, coalesce(i.names, '') AS children
FROM part LEFT JOIN (SELECT dst, count(DISTINCT src) n FROM calls GROUP BY dst) a ON a.dst = p_partkey
LEFT JOIN (SELECT src, count(DISTINCT dst) n FROM calls GROUP BY src) b ON b.src = p_partkey
LEFT JOIN (SELECT dst, array_to_string(list_sort(list_distinct(list(p_name))), ',') names FROM inherits JOIN part ON src = p_partkey GROUP BY dst) i ON i.dst = p_partkey""",
    "calls inherits",
)
def optional_degree_profile(spark, sf):
    g = star_graph(spark, sf)
    calls = g.edges("CALLS")
    rows = P.optional_count(_parts(g).select("id"), calls, "callers", incoming=True, distinct=True)
    rows = P.optional_count(rows, calls, "targets", distinct=True)
    rows = P.optional_collect(rows, g.edges("INHERITS"), _parts(g).select("id", "name"), "name", "children", incoming=True)
    return rows.select("id", "callers", "targets", F.array_join("children", ",").alias("children"))


@query(
    "most_connected",
    "SELECT id, p_name AS name, degree FROM (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM calls UNION ALL SELECT dst FROM calls) e GROUP BY id) d JOIN part ON id = p_partkey ORDER BY degree DESC, id LIMIT 10",
    "calls",
)
def most_connected(spark, sf):
    g = star_graph(spark, sf)
    return P.top_k(P.degree(g.edges("CALLS")).join(_parts(g).select("id", "name"), "id"), [F.desc("degree"), F.asc("id")], 10).select("id", "name", "degree")


@query("calls_per_node", "SELECT p_partkey AS id, count(src) AS calls FROM part LEFT JOIN calls ON src = p_partkey GROUP BY 1", "calls")
def calls_per_node(spark, sf):
    g = star_graph(spark, sf)
    return P.optional_count(_parts(g).select("id"), g.edges("CALLS"), "calls")


@query(
    "chain_distinct",
    """SELECT DISTINCT r_name AS region, p_brand AS brand FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey""",
)
def chain_distinct(spark, sf):
    g = star_graph(spark, sf)
    rows = g.node("Region").select(F.col("id").alias("r"), F.col("name").alias("region"))
    for rel, at, to in (("REGION_CONTAINS_NATION", "r", "n"), ("NATION_CONTAINS_CUSTOMER", "n", "c"), ("CUSTOMER_CONTAINS_ORDER", "c", "o"), ("ORDER_CONTAINS_PART", "o", "p")):
        rows = P.expand(rows, g.edges(rel), at, to).select("region", to)
    # Only distinct (region, part) pairs meet the last join.
    return rows.distinct().join(g.node("Part").select(F.col("id").alias("p"), "brand"), "p").select("region", "brand").distinct()


@query("contains_counts", "SELECT src AS holder, count(*) AS held FROM contains GROUP BY 1 ORDER BY held DESC, holder LIMIT 10", "contains")
def contains_counts(spark, sf):
    g = star_graph(spark, sf)
    counts = g.any_edge("CONTAINS").groupBy(F.col("src").alias("holder")).agg(F.count(F.lit(1)).alias("held"))
    return P.top_k(counts, [F.desc("held"), F.asc("holder")], 10)


@query("most_imported", "SELECT s_name AS name, count(DISTINCT src) AS importers FROM imports JOIN supplier ON dst = s_suppkey GROUP BY 1 ORDER BY importers DESC, name LIMIT 20", "imports")
def most_imported(spark, sf):
    g = star_graph(spark, sf)
    rows = P.expand(g.node("Supplier").select("id", "name"), g.edges("IMPORTS"), "id", "by", reverse=True)
    return P.top_k(rows.groupBy("name").agg(F.count_distinct("by").alias("importers")), [F.desc("importers"), F.asc("name")], 20)


@query("external_deps", "SELECT p_brand AS brand, count(*) AS n FROM part WHERE NOT EXISTS (SELECT 1 FROM calls WHERE src = p_partkey) GROUP BY 1", "calls")
def external_deps(spark, sf):
    g = star_graph(spark, sf)
    return P.anti(g.node("Part").select("id", "brand"), g.edges("CALLS")).groupBy("brand").agg(F.count(F.lit(1)).alias("n"))


@query("duplicate_names", "SELECT p_name AS name, count(DISTINCT p_brand) AS brands FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def duplicate_names(spark, sf):
    # A product of nodes with themselves on equal names and unlike files: a count of kinds instead.
    g = star_graph(spark, sf)
    return g.node("Part").groupBy("name").agg(F.count_distinct("brand").alias("brands")).filter("brands > 1")


@query("high_value", "SELECT p_partkey AS id, p_retailprice AS price FROM part WHERE p_retailprice > 990")
def high_value(spark, sf):
    return star_graph(spark, sf).node("Part").filter("price > 990").select("id", "price")


@query("count_high_value", "SELECT count(*) AS n FROM part WHERE p_retailprice > 990")
def count_high_value(spark, sf):
    return star_graph(spark, sf).node("Part").filter("price > 990").agg(F.count(F.lit(1)).alias("n"))


@query("long_span", "SELECT p_partkey AS id, CAST(p_size AS BIGINT) - 1 + 1 AS lines FROM part WHERE p_size - 1 > 45")
def long_span(spark, sf):
    return star_graph(spark, sf).node("Part").filter("size - 1 > 45").select("id", (F.col("size") - 1 + 1).alias("lines"))


@query("abstract_flag", "SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_acctbal < 0")
def abstract_flag(spark, sf):
    flagged = star_graph(spark, sf).node("Supplier").withColumn("is_abstract", F.col("balance") < 0)
    return flagged.filter("is_abstract").select("id", "name")


@query("missing_text", "SELECT doc_id AS id FROM documents WHERE (text IS NULL OR trim(text) = '') OR NOT starts_with(lower(lang), 'e')")
def missing_text(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.filter((F.col("text").isNull() | (F.trim("text") == "")) | ~F.lower("lang").startswith("e")).select(F.col("doc_id").alias("id"))


@query("many_tokens", "SELECT doc_id AS id, CAST(len(string_split(text, ',')) AS BIGINT) AS tokens FROM documents WHERE len(string_split(text, ',')) > 5")
def many_tokens(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), F.size(F.split("text", ",")).cast("long").alias("tokens"))
    return d.filter("tokens > 5")


@query("path_contains", "SELECT page_id AS id, url FROM pages WHERE contains(url, 'example') OR contains(url, '/1')")
def path_contains(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").filter(F.col("url").contains("example") | F.col("url").contains("/1")).select(F.col("page_id").alias("id"), "url")


@query("starts_with", "SELECT p_partkey AS id, p_name AS name FROM part WHERE starts_with(p_name, 'cold') ")
def starts_with(spark, sf):
    return star_graph(spark, sf).node("Part").filter(F.col("name").startswith("cold")).select("id", "name")


@query("all_by_size", "SELECT p_partkey AS id, p_name AS name, CAST(p_size AS BIGINT) AS size FROM part ORDER BY size DESC, id")
def all_by_size(spark, sf):
    return _parts(star_graph(spark, sf)).orderBy(F.desc("size"), "id")


@query("entity_counts", "SELECT label AS entity_type, count(*) AS n FROM nodes GROUP BY 1", "nodes")
def entity_counts(spark, sf):
    return star_graph(spark, sf).any_node().groupBy(F.col("label").alias("entity_type")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "rel_counts",
    "SELECT t AS rel_type, count(*) AS n FROM (SELECT t FROM contains UNION ALL SELECT 'CALLS' FROM calls UNION ALL SELECT 'INHERITS' FROM inherits UNION ALL SELECT 'IMPORTS' FROM imports) x GROUP BY 1",
    "contains calls inherits imports",
)
def rel_counts(spark, sf):
    return star_graph(spark, sf).any_edge().groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"))


@query("distinct_labels", "SELECT DISTINCT label FROM nodes", "nodes")
def distinct_labels(spark, sf):
    return star_graph(spark, sf).any_node().select("label").distinct()


_QUOTA = 1000 // 6 + 1


@query("graph_export_nodes", f"SELECT label, label || ':' || id AS gid, name FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY label || ':' || id) k FROM nodes) x WHERE k <= {_QUOTA}", "nodes")
def graph_export_nodes(spark, sf):
    return P.quota(star_graph(spark, sf).any_node(), "label", "gid", _QUOTA).select("label", "gid", "name")


@query(
    "graph_export_edges",
    f""", kept AS (SELECT label || ':' || id AS gid FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY label || ':' || id) k FROM nodes) x WHERE k <= {_QUOTA})
SELECT t AS rel_type, src, dst FROM contains WHERE src IN (SELECT gid FROM kept) AND dst IN (SELECT gid FROM kept)""",
    "nodes contains",
)
def graph_export_edges(spark, sf):
    g = star_graph(spark, sf)
    return P.induced(g.any_edge("CONTAINS"), P.quota(g.any_node(), "label", "gid", _QUOTA)).select("rel_type", "src", "dst")


@query("client_filter", "SELECT label, id, name FROM nodes WHERE lower(label) IN ('part', 'supplier') AND contains(lower(name), 'widget')", "nodes")
def client_filter(spark, sf):
    rows = V.filtered(star_graph(spark, sf).any_node(["Part", "Supplier"]), ("PART", "Supplier"), "Widget", kind="label")
    return rows.select("label", F.split_part("gid", F.lit(":"), F.lit(2)).cast("long").alias("id"), "name")


@query("view_neighbours", "SELECT src, dst, CAST(line_number AS BIGINT) AS line_number FROM calls WHERE src = 223 OR dst = 223", "calls")
def view_neighbours(spark, sf):
    return V.neighbours(star_graph(spark, sf).edges("CALLS"), 223)


@query("view_labels", "SELECT label, id, CASE WHEN length(name) > 15 THEN left(name, 12) || '...' ELSE name END AS short FROM nodes", "nodes")
def view_labels(spark, sf):
    rows = star_graph(spark, sf).any_node()
    return rows.select("label", F.split_part("gid", F.lit(":"), F.lit(2)).cast("long").alias("id"), V.short_label(F.col("name")).alias("short"))


@query("view_edge_labels", "SELECT CASE WHEN contains(t, '_CONTAINS_') THEN 'contains' ELSE lower(t) END AS label, count(*) AS n FROM (SELECT t FROM contains UNION ALL SELECT 'CALLS' FROM calls) x GROUP BY 1", "contains calls")
def view_edge_labels(spark, sf):
    g = star_graph(spark, sf)
    rows = g.any_edge("CONTAINS").unionByName(g.any_edge("CALLS"))
    return rows.groupBy(V.relation_label(F.col("rel_type")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("view_bounds", "SELECT CAST(min(p_size) AS BIGINT) AS min_x, CAST(max(p_size) AS BIGINT) AS max_x, min(p_retailprice) AS min_y, max(p_retailprice) AS max_y FROM part")
def view_bounds(spark, sf):
    return V.bounds(star_graph(spark, sf).node("Part"), "size", "price")


@query("view_window", ", box AS (SELECT p_partkey AS id FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice BETWEEN 920 AND 960) SELECT src, dst, CAST(line_number AS BIGINT) AS line_number FROM calls WHERE src IN (SELECT id FROM box) OR dst IN (SELECT id FROM box)", "calls")
def view_window(spark, sf):
    g = star_graph(spark, sf)
    return V.in_window(g.node("Part"), g.edges("CALLS"), (10, 920, 20, 960), x="size", y="price")[1]


@query("view_styles", "SELECT label, '#6b7280' AS colour, CAST(10 AS INTEGER) AS size, count(*) AS n FROM nodes GROUP BY 1", "nodes")
def view_styles(spark, sf):
    rows = V.styled(star_graph(spark, sf).any_node(), "label")
    return rows.groupBy("label", "colour", "size").agg(F.count(F.lit(1)).alias("n"))


@query("view_chunks", "SELECT CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS BIGINT) AS chunk, o_orderkey AS id FROM orders")
def view_chunks(spark, sf):
    return V.chunked(star_graph(spark, sf).node("Order").select("id"), "id", least=100).select("chunk", "id")


@query("delete_detach", "SELECT src, dst, count(*) AS n FROM calls WHERE src NOT IN (SELECT p_partkey FROM part WHERE p_size > 40) AND dst NOT IN (SELECT p_partkey FROM part WHERE p_size > 40) GROUP BY 1, 2", "calls")
def delete_detach(spark, sf):
    g = star_graph(spark, sf)
    gone = g.node("Part").filter("size > 40").select("id")
    left = g.edges("CALLS").join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return left.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query(
    "change_detection",
    """SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' WHEN o.h <> n.h THEN 'modified' ELSE 'unchanged' END AS change
FROM (SELECT doc_id, sha256(text) h FROM documents WHERE lang <> 'de') o
FULL JOIN (SELECT doc_id, sha256(CASE WHEN lang = 'es' THEN text || ' ' ELSE text END) h FROM documents WHERE lang <> 'fr') n ON o.doc_id = n.doc_id""",
)
def change_detection(spark, sf):
    # Two snapshots of one table: each lacks some rows, and some texts differ.
    d = spark.read.parquet(f"{sf}/documents.parquet")
    old = d.filter("lang <> 'de'").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    new = d.filter("lang <> 'fr'").select("doc_id", F.sha2(F.when(F.col("lang") == "es", F.concat("text", F.lit(" "))).otherwise(F.col("text")).cast("binary"), 256).alias("h"))
    return P.changes(old, new, "doc_id", "h")


@query("loc_count", r"SELECT doc_id, CAST(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(trim(x), '#'))) AS BIGINT) AS loc FROM documents")
def loc_count(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", X.lines_of_code(F.col("text")).alias("loc"))


@query(
    "html_links_bindings",
    r"""SELECT page_id, CAST(len(list_distinct(regexp_extract_all(html, '<(app-[a-z-]+)', 1))) AS BIGINT) AS components,
CAST(len(regexp_extract_all(html, '\[.*?\]')) AS BIGINT) AS properties, CAST(len(regexp_extract_all(html, '\(.*?\)')) AS BIGINT) AS events,
CAST(len(regexp_extract_all(html, '\{\{.*?\}\}')) AS BIGINT) AS interpolations, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))), ' ') AS links FROM pages""",
)
def html_links_bindings(spark, sf):
    h = F.col("html")
    return spark.read.parquet(f"{sf}/pages.parquet").select(
        "page_id",
        F.size(X.distinct_matches(h, X.APP_TAG)).cast("long").alias("components"),
        F.regexp_count(h, F.lit(X.PROPERTY_BINDING)).cast("long").alias("properties"),
        F.regexp_count(h, F.lit(X.EVENT_BINDING)).cast("long").alias("events"),
        F.regexp_count(h, F.lit(X.INTERPOLATION)).cast("long").alias("interpolations"),
        F.array_join(F.array_sort(X.distinct_matches(h, 'href="([^"]*)"')), " ").alias("links"),
    )


@query("brace_nesting")
def brace_nesting(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", X.nesting_depth(F.col("html")).cast("long").alias("depth"))


SQL["brace_nesting"] = r"""
WITH c AS (SELECT page_id, regexp_replace(html, '[^{}]', '', 'g') AS b FROM pages),
s AS (SELECT page_id, i, sum(CASE b[i] WHEN '{' THEN 1 ELSE -1 END) OVER (PARTITION BY page_id ORDER BY i) AS h FROM (SELECT page_id, b, unnest(range(1, len(b) + 1)) AS i FROM c)),
f AS (SELECT page_id, h - least(0, min(h) OVER (PARTITION BY page_id ORDER BY i)) AS d FROM s)
SELECT p.page_id, CAST(coalesce(max(f.d), 0) AS BIGINT) AS depth FROM pages p LEFT JOIN f ON p.page_id = f.page_id GROUP BY 1"""


@query("containing_interval")
def containing_interval(spark, sf):
    g = star_graph(spark, sf)
    points = g.node("Order").select("id", (F.col("id") % 5).alias("file"), (F.col("id") % 1000).alias("line"))
    low = F.col("id") % 900
    spans = g.node("Part").select(F.col("id").alias("part_id"), (F.col("id") % 5).alias("file"), low.alias("lo"), (low + F.col("size") * 20 + F.col("id") % 13).alias("hi"))
    return P.smallest_enclosing(points, spans, "file", "line", "lo", "hi", "part_id").select("id", F.coalesce("part_id", F.lit(-1)).alias("part_id"))


SQL["containing_interval"] = """
WITH s AS (SELECT p_partkey AS part_id, p_partkey % 5 AS f, p_partkey % 900 AS lo, p_partkey % 900 + p_size * 20 + p_partkey % 13 AS hi FROM part),
o AS (SELECT o_orderkey AS id, o_orderkey % 5 AS f, o_orderkey % 1000 AS line FROM orders),
r AS (SELECT o.id, s.part_id, row_number() OVER (PARTITION BY o.id ORDER BY s.hi - s.lo, s.lo, s.part_id) AS k FROM o LEFT JOIN s ON o.f = s.f AND o.line BETWEEN s.lo AND s.hi)
SELECT id, coalesce(part_id, -1) AS part_id FROM r WHERE k = 1"""


@query(
    "nearest_following",
    """SELECT id, coalesce(next_id, -1) AS next_id FROM (SELECT l.event_id AS id, r.event_id AS next_id, row_number() OVER (PARTITION BY l.event_id ORDER BY r.ts, r.event_id) AS k
FROM (SELECT * FROM events WHERE event_type = 'view') l LEFT JOIN (SELECT * FROM events WHERE event_type <> 'view') r
ON l.user_id = r.user_id AND epoch(r.ts) >= epoch(l.ts) AND epoch(r.ts) - epoch(l.ts) <= 86400) x WHERE k = 1""",
)
def nearest_following(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    left = e.filter("event_type = 'view'").select(F.col("event_id").alias("id"), "user_id", "at")
    right = e.filter("event_type <> 'view'").select(F.col("event_id").alias("next_id"), "user_id", "at")
    return P.nearest_after(left, right, ["user_id"], "at", 86_400_000_000, "next_id").select("id", F.coalesce("next_id", F.lit(-1)).alias("next_id"))


@query(
    "symbol_resolution",
    """, keyed AS (SELECT p_name AS key, p_partkey AS id, 0 AS weight FROM part UNION ALL SELECT p_brand, p_partkey, 1 FROM part)
SELECT s_suppkey AS ref, coalesce(k.id, -1) AS id FROM supplier LEFT JOIN (SELECT key, id, row_number() OVER (PARTITION BY key ORDER BY weight DESC, id) r FROM keyed) k
ON k.r = 1 AND k.key = CASE WHEN s_suppkey % 3 = 0 THEN 'cold widget' WHEN s_suppkey % 3 = 1 THEN 'Brand#' || (s_suppkey % 60) ELSE s_name END""",
    "calls",
)
def symbol_resolution(spark, sf):
    from plexgraph.operators.resolution import best_symbols

    g = star_graph(spark, sf)
    p = g.node("Part")
    symbols = p.select(F.col("name").alias("key"), "id", F.lit(0).alias("weight"), F.col("id").alias("ord")).unionByName(p.select(F.col("brand").alias("key"), "id", F.lit(1).alias("weight"), F.col("id").alias("ord")))
    s = g.node("Supplier")
    key = F.when(F.col("id") % 3 == 0, "cold widget").when(F.col("id") % 3 == 1, F.concat(F.lit("Brand#"), (F.col("id") % 60).cast("string"))).otherwise(F.col("name"))
    refs = s.select(F.col("id").alias("ref"), key.alias("key"))
    return refs.join(best_symbols(symbols), "key", "left").select("ref", F.coalesce("id", F.lit(-1)).alias("id"))


@query(
    "suffix_resolution",
    """, h AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages), n AS (SELECT unnest(['com', 'example.com', 'org', 'net', 'example.org']) AS sym)
SELECT sym, min(host) AS host FROM n LEFT JOIN h ON h.host = sym OR ends_with(h.host, '.' || sym) GROUP BY sym""",
    "calls",
)
def suffix_resolution(spark, sf):
    from plexgraph.operators.resolution import suffix_keys

    hosts = spark.read.parquet(f"{sf}/pages.parquet").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host")).distinct()
    keys = hosts.select("host", F.explode(suffix_keys(F.col("host"))).alias("sym")).groupBy("sym").agg(F.min("host").alias("host"))
    return spark.createDataFrame([(x,) for x in ("com", "example.com", "org", "net", "example.org")], "sym string").join(keys, "sym", "left")


@query("dedup_first", "SELECT name, id FROM (SELECT p_name AS name, p_partkey AS id, row_number() OVER (PARTITION BY p_name ORDER BY p_size, p_partkey) k FROM part) x WHERE k = 1")
def dedup_first(spark, sf):
    return P.first_of(star_graph(spark, sf).node("Part"), ["name"], ["size", "id"]).select("name", "id")


@query("dangling_edges", "SELECT src, dst FROM inherits WHERE dst NOT IN (SELECT p_partkey FROM part WHERE p_partkey >= 2)", "inherits")
def dangling_edges(spark, sf):
    g = star_graph(spark, sf)
    return P.anti(g.edges("INHERITS").withColumnRenamed("dst", "id"), g.node("Part").filter("id >= 2").select(F.col("id").alias("src")), key="id").select("src", F.col("id").alias("dst"))


@query("extraction_stats", "SELECT count(*) AS files, count(*) FILTER (WHERE text IS NULL OR text = '') AS failed, CAST(sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS BIGINT) AS english, count(DISTINCT source) AS sources FROM documents")
def extraction_stats(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("failed"), F.count_if(F.col("lang") == "en").alias("english"), F.count_distinct("source").alias("sources"))


@query(
    "tree_listing",
    """, u AS (SELECT string_split(regexp_replace(url, '^https?://', ''), '/') AS p FROM pages),
x AS (SELECT unnest(list_transform(range(1, len(p) + 1), lambda i: array_to_string(p[1:i], '/'))) AS path FROM u)
SELECT path, count(*) AS pages FROM x GROUP BY 1""",
    "calls",
)
def tree_listing(spark, sf):
    parts = F.split(F.regexp_replace("url", "^https?://", ""), "/")
    rows = spark.read.parquet(f"{sf}/pages.parquet").select(parts.alias("p"))
    prefixes = F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.array_join(F.slice("p", 1, i), "/"))
    return rows.select(F.explode(prefixes).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("pages"))


@query("schema_tables")
def schema_tables(spark, sf):
    return spark.createDataFrame(star_graph(spark, sf).tables(), "name string, type string")


SQL["schema_tables"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', '{k}')"
    for n, k in [
        *((x, "NODE") for x in ("Customer", "Nation", "Order", "Part", "Region", "Supplier")),
        *((x, "REL") for x in ("CALLS", "CUSTOMER_CONTAINS_ORDER", "IMPORTS", "INHERITS", "NATION_CONTAINS_CUSTOMER", "NATION_CONTAINS_SUPPLIER", "ORDER_CONTAINS_PART", "REGION_CONTAINS_NATION")),
    ]
) + ") t(name, type)"


@query("literal_row", "SELECT CAST(1 AS INTEGER) AS x, 'v' AS y")
def literal_row(spark, sf):
    return spark.sql("SELECT 1 AS x, :v AS y", args={"v": "v"})


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return most_called(spark, sf)
