"""The engine: build, update and query a code graph."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexgraph.operators import patterns as P
from plexgraph.plans import extract as E
from plexgraph.plans.catalog import NODE_COLUMNS
from plexgraph.session import ship
from plexgraph.sources import discover
from plexgraph.sources.store import BUCKETS, Store, bucket_of
from plexgraph.storage import Scratch, clear, stash

#: Changed files up to so many are read by their paths; more by a scan of the whole tree.
READ_BY_PATH = 1000
#: What the graph export covers unless asked for more.
EXPORT_LABELS = ("File", "Module", "Class", "Function", "Variable", "Import")


@dataclass
class Engine:
    spark: SparkSession
    root: str
    exclude: tuple[str, ...] = discover.EXCLUDED
    max_file_size: int = discover.MAX_FILE_SIZE
    statistics: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        ship(self.spark)
        self.store = Store(self.spark, self.root)

    def init(self, force: bool = False) -> int:
        version = self.store.current()
        return self.store.clear() if force or version is None else version

    def reset(self, confirmed: bool = False) -> int:
        """An empty graph. Asks to be told that this is meant."""
        if not confirmed:
            raise ValueError("reset deletes the graph; call reset(confirmed=True)")
        return self.store.clear()

    def update(self, source: str, full: bool = False) -> dict:
        """Bring the graph up to date with a source tree: parse what was added or modified, drop what is gone, and resolve
        the links of those files and all links that may mean a name they define or defined. Only buckets that hold such
        rows are written. Returns counters; ConflictError if another update was faster."""
        began, put = time.time(), Scratch(self.spark)
        try:
            return self._update(source, full, put, began)
        finally:
            put.close()

    def _parsed(self, source: str, fresh: DataFrame, count: int) -> DataFrame:
        """The files to parse. Few are read by their paths; many by a scan of the tree."""
        if count <= READ_BY_PATH:
            paths = [r["path"] for r in fresh.collect()]
            rows = discover.scan(self.spark, source, self.exclude, self.max_file_size, paths=paths) if paths else None
        else:
            rows = discover.scan(self.spark, source, self.exclude, self.max_file_size).join(fresh, "path", "left_semi")
        if rows is None:
            rows = self.spark.createDataFrame([], "path string, file_type string, text string, raw binary")
        return E.parse_files(rows)

    def _update(self, source: str, full: bool, put: Scratch, began: float) -> dict:
        base = self.store.manifest()
        read = lambda name, buckets=None: self.store.read(name, base["version"], buckets) if base["version"] else self.store.read(name)
        files = put(discover.scan(self.spark, source, self.exclude, self.max_file_size).drop("text", "raw"), "files")
        old = read("files")
        kinds = put(P.changes(old.limit(0) if full else old, files, "path", "hash"), "changes")
        count = {r["change"]: r["n"] for r in kinds.groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()}
        fresh = kinds.filter("change IN ('added', 'modified')").select("path")
        gone = kinds.filter("change IN ('removed', 'modified')").select(F.col("path").alias("file_path"))
        parsed = put(self._parsed(source, fresh, count.get("added", 0) + count.get("modified", 0)), "parsed")
        touched = fresh.select(F.col("path").alias("file_path")).unionByName(gone).distinct()
        dealt = {r["b"] for r in touched.select(bucket_of(F.col("file_path")).alias("b")).distinct().collect()}

        def renewed(name: str, new: DataFrame, buckets: set[int]) -> DataFrame:
            rows = read(name, buckets)
            return new if full else rows.join(gone, "file_path", "left_anti").unionByName(new.select(*rows.columns))

        def all_of(name: str) -> DataFrame:
            """The rows of other files, then those of fresh ones."""
            return read(name, set(range(BUCKETS))).join(gone, "file_path", "left_anti")

        hashed = files.select(F.col("path").alias("file_path"), F.map_from_arrays(F.array(F.lit("hash"), F.lit("modified_time")), F.array("hash", F.col("modified_time").cast("string"))).alias("more"))
        new = E.entities_of(parsed).join(hashed, "file_path", "left").withColumn("props", F.when((F.col("type") == "File") & F.col("more").isNotNull(), F.map_concat("props", "more")).otherwise(F.col("props"))).drop("more")
        new = put(new, "new-entities")
        new_links = put(E.links_of(parsed), "new-links")
        none = full or base["version"] is None
        entities = new if none else all_of("entities").unionByName(new.select(*read("entities").columns))
        if none:
            asked = new_links
        else:
            # Names that the changed files define or defined: whatever may mean one of them is resolved again.
            before = read("entities", dealt).join(gone, "file_path", "left_semi")
            keys = put(E.symbols_of(before).select("key").unionByName(E.symbols_of(new).select("key")).distinct(), "keys")
            others = all_of("links")
            means = E.references_of(others).select("end", "file_path", F.explode("candidates").alias("key")).join(keys, "key", "left_semi").select("end", "file_path").distinct()
            means = put(means, "means")
            again = others.join(means.withColumnRenamed("end", "source"), ["source", "file_path"], "left_semi").unionByName(others.join(means.withColumnRenamed("end", "target"), ["target", "file_path"], "left_semi")).dropDuplicates(["file_path", "ordinal"])
            asked = put(again.unionByName(new_links.select(*again.columns)), "asked")
        edges, dropped = E.resolve_links(asked, entities)
        edges, dropped = put(edges, "edges"), put(dropped, "dropped")
        moved = asked.select("file_path", "ordinal")
        ends = dealt if none else dealt | {r["b"] for r in asked.select(bucket_of(F.col("file_path")).alias("b")).distinct().collect()}

        def rejoined(name: str, found: DataFrame) -> DataFrame:
            if none:
                return found
            rows = read(name, ends)
            return rows.join(gone, "file_path", "left_anti").join(moved, ["file_path", "ordinal"], "left_anti").unionByName(found.select(*rows.columns)).select(*rows.columns)

        errors = parsed.filter("kind = 'error'").select("file_path", "message")
        tables = {"files": files, "entities": renewed("entities", new, dealt), "links": renewed("links", new_links, dealt), "errors": renewed("errors", errors, dealt), "edges": rejoined("edges", edges), "dropped": rejoined("dropped", dropped)}
        buckets = {} if none else {"entities": dealt, "links": dealt, "errors": dealt, "edges": ends, "dropped": ends}
        # Stubs stand for names that no file defines by now; they follow the links that were dropped.
        left = tables["dropped"] if none else read("dropped", set(range(BUCKETS)) - ends).unionByName(tables["dropped"].select(*read("dropped").columns))
        stubs = E.external_stubs(left).select("id", "name", F.lit("").alias("file_path"), F.lit(None).cast("long").alias("line_start"), F.lit(None).cast("long").alias("line_end"), F.lit(-1).alias("ordinal"), "props", "type")
        if touched.isEmpty() and base["version"] is not None:
            # Nothing has changed but perhaps times.
            tables, stubs = {"files": files}, None
        version = self.store.write(tables | ({"stubs": stubs} if stubs is not None else {}), base if base["version"] else None, buckets)
        made = {r["kind"]: r["n"] for r in parsed.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
        failed = parsed.filter("kind = 'error'").select("file_path").distinct().count()
        self.statistics = {
            "version": version, "total_files": sum(n for k, n in count.items() if k != "removed"),
            "files_added": count.get("added", 0), "files_modified": count.get("modified", 0), "files_removed": count.get("removed", 0), "files_unchanged": count.get("unchanged", 0),
            **self._counted("entities", E.entities_of(parsed), kinds, dealt, base, none), **self._counted("relationships", new_links, kinds, dealt, base, none),
            "errors": made.get("error", 0), "files_failed": failed, "update_time": time.time() - began,
        }
        return self.statistics

    def _counted(self, what: str, rows: DataFrame, kinds: DataFrame, buckets: set[int], base: dict, none: bool) -> dict[str, int]:
        """Rows of added files, of modified ones as they are now, and those that went with removed files."""
        change = kinds.select(F.col("path").alias("file_path"), "change")
        now = {r["change"]: r["n"] for r in rows.join(change, "file_path").groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()}
        table = "entities" if what == "entities" else "links"
        removed = 0 if none else self.store.read(table, base["version"], buckets).join(change.filter("change = 'removed'"), "file_path", "left_semi").count()
        return {f"{what}_added": now.get("added", 0), f"{what}_updated": now.get("modified", 0), f"{what}_removed": removed}

    def query(self, text: str, params: dict | None = None) -> DataFrame:
        from plexgraph.plans.cypher import run

        return run(self.store.catalog(), text, params or {})

    def templates(self) -> DataFrame:
        from plexgraph.plans.templates import TEMPLATES

        rows = [(k, t["name"], t["category"], t["query"], ",".join(t["parameters"])) for k, t in TEMPLATES.items()]
        return self.spark.createDataFrame(rows, "id string, name string, category string, query string, parameters string")

    def run_template(self, template: str, /, **params) -> DataFrame:
        from plexgraph.plans.templates import TEMPLATES

        return self.query(TEMPLATES[template]["query"], params)

    def graph(self, labels: tuple[str, ...] = EXPORT_LABELS, max_nodes: int = 1000, max_edges: int = 5000, file_filter: str | None = None, search: str | None = None) -> tuple[DataFrame, DataFrame, dict]:
        """Nodes and induced edges for display: an equal quota for each label and type, first by id; and their counts."""
        entities = self.store.read("entities").filter(F.col("type").isin(*labels))
        if file_filter:
            entities = entities.filter(F.col("file_path").contains(file_filter))
        if search:
            entities = entities.filter(F.lower("name").contains(search.lower()) | F.lower("file_path").contains(search.lower()))
        nodes = stash(P.quota(entities.select("id", "name", "type", "file_path", "line_start", "line_end"), "type", "id", max_nodes // max(1, len(labels)) + 1), "graph-nodes")
        edges = P.induced(self.store.read("edges").select("src", "dst", "rel_type"), nodes, "id")
        edges = P.quota(edges.withColumn("_o", F.concat_ws(":", "src", "dst")), "rel_type", "_o", max_edges // 15 + 1).drop("_o")
        return nodes, edges, {"total_nodes": nodes.count(), "total_edges": edges.count(), "node_types": list(labels)}

    def tree(self) -> DataFrame:
        return discover.tree(self.store.read("files"))

    def status(self) -> dict:
        """Counts, time of the last update and health: healthy, degraded (a table or column is missing or of another
        type) or empty (no version)."""
        manifest = self.store.manifest()
        version, checked = manifest["version"], self.store.validate()
        entities, edges = self.store.read("entities"), self.store.read("edges")
        return {
            "version": version, "last_update": manifest["at"], "healthy": checked["valid"], "state": "empty" if version is None else "healthy" if checked["valid"] else "degraded",
            "problems": [f"{k}: {x}" for k in ("missing", "unexpected", "types", "errors") for x in checked[k]], "tracked_files": self.store.read("files").count(),
            "nodes": entities.count(), "relationships": edges.count(), "tables": len(self.store.catalog().tables()), "labels": len(NODE_COLUMNS),
        }

    def close(self) -> None:
        """Delete the intermediate tables of this application; results that still read them are lost."""
        clear(self.spark)

    def orphans(self) -> DataFrame:
        """Entities of files that are not tracked; an update leaves none."""
        return self.store.read("entities").filter("file_path <> ''").join(self.store.read("files").select(F.col("path").alias("file_path")), "file_path", "left_anti")

    def export(self, path: str, form: str = "json") -> None:
        """Entities and edges as JSON or CSV folders; CSV has properties as JSON text."""
        for name in ("entities", "edges"):
            rows = self.store.read(name)
            (rows.withColumn("props", F.to_json("props")) if form == "csv" else rows).write.mode("overwrite").format(form).option("header", True).save(f"{path}/{name}")
