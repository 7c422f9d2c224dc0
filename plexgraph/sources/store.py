"""A versioned graph store on Parquet.

Rows are dealt by a hash of their file's path into buckets. A version is a small manifest that names the folder of each
bucket of each table, so an update writes the buckets that it changes into a folder of its own and takes over the rest.
A manifest is created once and never replaced: of two writers that start from one version, the second finds the name
taken and fails, and what it has written stays unseen. Nothing is overwritten, so a failed update leaves the graph as it
was; vacuum() deletes what no kept version names.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexgraph.plans.catalog import NODE_COLUMNS, REL_COLUMNS, GraphCatalog, contains_types
from plexgraph.plans.extract import label_view, rel_view
from plexgraph.storage import at, delete

_P = "map<string,string>"
SCHEMAS = {
    "files": "path string, name string, extension string, file_type string, size long, modified_time long, hash string",
    "entities": f"id string, name string, file_path string, line_start long, line_end long, ordinal int, props {_P}, type string",
    "stubs": f"id string, name string, file_path string, line_start long, line_end long, ordinal int, props {_P}, type string",
    "links": f"source string, target string, file_path string, ordinal int, props {_P}, rel_type string",
    "edges": f"from_label string, to_label string, src string, dst string, props {_P}, file_path string, ordinal int, rel_type string",
    "dropped": "source string, target string, file_path string, ordinal int, rel_type string",
    "errors": "file_path string, message string",
    "pairs": "rel_type string, from_label string, to_label string, bucket int",
}
#: Rows of a bucket stand in order of this, so that a scan for one label skips what it can.
_ORDER = {"entities": "type", "stubs": "type", "edges": "rel_type"}
BUCKETS = 16


class ConflictError(RuntimeError):
    """Another writer has made the next version."""


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _key(name: str) -> str:
    return {"files": "path", "stubs": "id"}.get(name, "file_path")


@dataclass
class Store:
    spark: SparkSession
    root: str
    _manifests: dict[int, dict] = field(default_factory=dict)

    def versions(self) -> list[int]:
        fs, p = at(self.spark, f"{self.root}/commits")
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName()[1:-5]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json") and s.getLen())

    def current(self) -> int | None:
        return max(self.versions(), default=None)

    def manifest(self, version: int | None = None) -> dict:
        """version, time and the folder of each bucket of each table; empty without a version."""
        version = self.current() if version is None else version
        if version is None:
            return {"version": None, "at": None, "tables": {}}
        if version not in self._manifests:
            fs, p = at(self.spark, f"{self.root}/commits/v{version:08d}.json")
            stream = fs.open(p)
            self._manifests[version] = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
        return self._manifests[version]

    def _table(self, name: str, manifest: dict, buckets: set[int] | None = None) -> DataFrame:
        folders = {int(b): f for b, f in manifest["tables"].get(name, {}).items()}
        paths = [f"{self.root}/data/{f}/{name}/_b={b}" for b, f in sorted(folders.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[name])

    def read(self, name: str, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """A table of a version, or some of its buckets. Entities include the stubs of names that no file defines."""
        manifest = self.manifest(version)
        rows = self._table(name, manifest, buckets)
        return rows.unionByName(self._table("stubs", manifest)) if name == "entities" and buckets is None else rows

    def write(self, tables: dict[str, DataFrame], base: dict | None = None, buckets: dict[str, set[int]] | None = None) -> int:
        """The next version after base (the current one if it is not given). Of a table with buckets named, those are
        replaced by its rows and the others taken over from base; without, all are replaced. Tables not given are taken
        over if base was given, else empty. Visible only when all is written."""
        version = ((base or self.manifest())["version"] or 0) + 1
        if "edges" in tables:
            pairs = tables["edges"].select("rel_type", "from_label", "to_label", bucket_of(F.col("file_path")).alias("bucket")).distinct()
            tables, buckets = tables | {"pairs": pairs}, (buckets or {}) | ({"pairs": buckets["edges"]} if buckets and "edges" in buckets else {})
        folder = uuid.uuid4().hex
        found: dict[str, dict[str, str]] = {}
        for name, schema in SCHEMAS.items():
            old = base["tables"].get(name, {}) if base else {}
            if name not in tables:
                found[name] = old
                continue
            names = [c.split()[0] for c in schema.split(", ") if " " in c]
            bucket = F.col("bucket") if name == "pairs" else bucket_of(F.col(_key(name)))
            rows = tables[name].select(*names).withColumn("_b", bucket).repartition(BUCKETS, "_b")
            path = f"{self.root}/data/{folder}/{name}"
            rows.sortWithinPartitions("_b", *([_ORDER[name]] if name in _ORDER else [])).write.partitionBy("_b").parquet(path)
            fs, p = at(self.spark, path)
            new = {s.getPath().getName()[3:]: folder for s in fs.listStatus(p) if s.getPath().getName().startswith("_b=")}
            kept = {b: f for b, f in old.items() if int(b) not in buckets[name]} if buckets and name in buckets else {}
            found[name] = kept | new
        self._commit(version, {"version": version, "at": int(time.time()), "tables": found})
        return version

    def _commit(self, version: int, manifest: dict) -> None:
        fs, p = at(self.spark, f"{self.root}/commits/v{version:08d}.json")
        try:
            out = fs.create(p, False)
        except Exception as e:
            if fs.exists(p):
                raise ConflictError(f"version {version} was made by another writer") from e
            raise
        out.write(json.dumps(manifest).encode())
        out.close()

    def clear(self) -> int:
        """An empty version."""
        return self.write({})

    def drop(self) -> None:
        """Delete all versions: the commits first, so that no reader finds half of one."""
        for part in ("commits", "data"):
            delete(self.spark, f"{self.root}/{part}")
        self._manifests.clear()

    def vacuum(self, keep: int = 2) -> int:
        """Delete all but the newest versions, and every bucket's folder that none of those names. Not while an update
        runs, whose folders no version names yet. Returns the number of folders deleted."""
        stay = self.versions()[-keep:]
        used = {(f, t, b) for v in stay for t, of in self.manifest(v)["tables"].items() for b, f in of.items()}
        for v in self.versions()[:-keep]:
            delete(self.spark, f"{self.root}/commits/v{v:08d}.json")
            self._manifests.pop(v, None)

        def names(path: str) -> list[str]:
            fs, p = at(self.spark, path)
            return [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []

        gone = 0
        for f in names(f"{self.root}/data"):
            buckets = [(t, b) for t in names(f"{self.root}/data/{f}") for b in names(f"{self.root}/data/{f}/{t}") if b.startswith("_b=")]
            spent = [(t, b) for t, b in buckets if (f, t, b[3:]) not in used]
            for path in [""] if len(spent) == len(buckets) else [f"/{t}/{b}" for t, b in spent]:
                delete(self.spark, f"{self.root}/data/{f}{path}")
            gone += len(spent)
        return gone

    def catalog(self) -> GraphCatalog:
        """Labels and types as views of the current version; CONTAINS for all containments."""
        g = GraphCatalog()
        entities, edges = self.read("entities"), self.read("edges")
        for label in NODE_COLUMNS:
            g.add_node(label, lambda label=label: label_view(entities, label))
        # A type joins its declared pair of labels and whatever other pairs the version holds.
        pairs = {(r["rel_type"], r["from_label"], r["to_label"]) for r in self.read("pairs").select("rel_type", "from_label", "to_label").distinct().collect()}
        pairs |= {(name, source, target) for name, (source, target, _) in REL_COLUMNS.items()}
        for name, source, target in sorted(pairs):
            g.add_rel(name, source, target, lambda name=name, source=source, target=target: rel_view(edges.filter((F.col("from_label") == source) & (F.col("to_label") == target)), name))
        g.aliases["CONTAINS"] = contains_types()
        return g

    def validate(self) -> dict:
        """Columns that are missing or of another type, tables that are missing or not known, and errors; valid if there
        are none."""
        out: dict = {"missing": [], "unexpected": [], "types": [], "errors": []}
        try:
            manifest = self.manifest()
        except Exception as e:
            return out | {"errors": [str(e)[:200]], "valid": False}
        if manifest["version"] is None:
            out["errors"].append("no version")
        out["unexpected"] = sorted(set(manifest["tables"]) - set(SCHEMAS))
        for name in SCHEMAS if manifest["version"] is not None else ():
            if name not in manifest["tables"]:
                out["missing"].append(name)
                continue
            want = {f.name: f.dataType.simpleString() for f in self.spark.createDataFrame([], SCHEMAS[name]).schema}
            for b, f in manifest["tables"][name].items():
                try:
                    have = {x.name: x.dataType.simpleString() for x in self.spark.read.parquet(f"{self.root}/data/{f}/{name}/_b={b}").schema}
                except AnalysisException as e:
                    out["errors"].append(f"{name}, bucket {b}: {str(e)[:120]}")
                    continue
                out["missing"] += [f"{name}.{c}" for c in sorted(want.keys() - have.keys()) if f"{name}.{c}" not in out["missing"]]
                out["types"] += [f"{name}.{c}: {have[c]}" for c in sorted(want.keys() & have.keys()) if have[c] != want[c] and f"{name}.{c}: {have[c]}" not in out["types"]]
        return out | {"valid": not any(out.values())}
