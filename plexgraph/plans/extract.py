"""From files to a graph: distributed parsing, symbol resolution by joins, typed edges."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexgraph.functions.text import sanitised
from plexgraph.operators.patterns import first_of
from plexgraph.operators.resolution import resolve, suffix_keys
from plexgraph.plans.catalog import MORE_COLUMNS, NODE_COLUMNS, REL_COLUMNS

_ROW = "kind string, file_path string, ordinal int, id string, name string, type string, line_start long, line_end long, source string, target string, props map<string,string>, message string"


def parse_files(files: DataFrame) -> DataFrame:
    """files (path, file_type, text, perhaps raw) to tagged rows: entity, link or error. One pass; a file that fails gives
    an error. Of bytes that are not UTF-8 the bad ones are passed over, but a Python file with any gives an error only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from plexgraph.parsers import parse
        from plexgraph.parsers.records import Parsed

        for pdf in batches:
            rows = []
            for path, kind, text, raw in zip(pdf["path"], pdf["file_type"], pdf["text"], pdf["raw"]):
                if raw is None:
                    p = parse(path, text or "", kind)
                elif kind == "python":
                    p = Parsed(path, errors=["UnicodeDecodeError: the file is not UTF-8"])
                else:
                    p = parse(path, raw.decode("utf-8", "ignore"), kind)
                rows += [("entity", path, k, e.id, e.name, e.type, e.line_start, e.line_end, None, None, e.props, None) for k, e in enumerate(p.entities)]
                rows += [("link", path, k, None, None, x.type, None, None, x.source, x.target, x.props, None) for k, x in enumerate(p.links)]
                rows += [("error", path, k, None, None, None, None, None, None, None, None, m) for k, m in enumerate(p.errors)]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in _ROW.split(", ")])
            yield out.astype({"ordinal": "int32", "line_start": "Int64", "line_end": "Int64"})

    raw = F.col("raw") if "raw" in files.columns else F.lit(None).cast("binary").alias("raw")
    return files.select("path", "file_type", "text", raw).mapInPandas(run, _ROW)


def entities_of(parsed: DataFrame) -> DataFrame:
    """Entities, once for each id: the first by (path, ordinal)."""
    rows = parsed.filter("kind = 'entity'").select("id", sanitised(F.col("name")).alias("name"), "type", "file_path", "line_start", "line_end", "ordinal", "props")
    return first_of(rows, ["id"], ["file_path", "ordinal"])


def links_of(parsed: DataFrame) -> DataFrame:
    return parsed.filter("kind = 'link'").select("source", "target", F.col("type").alias("rel_type"), "file_path", "ordinal", "props")


def _asset_keys(kind: str) -> F.Column:
    """Keys of a template or style sheet: its path, its name with and without ./, and its path from src/app on."""
    head, name = F.lit(f"{kind}:"), F.element_at(F.split("file_path", "/"), -1)
    below = F.regexp_extract("file_path", r"(?:^|/)src/(?:.*/)?(app/.*)$", 1)
    return F.array(F.concat(head, "file_path"), F.concat(head, name), F.concat(head, F.lit("./"), name), F.when(below != "", F.concat(head, F.lit("./"), below)))


def _beside(path, target) -> F.Column:
    """A path named in a file, from the root: . and .. are worked off."""
    parts = F.filter(F.split(F.concat(F.regexp_extract(path, r"^(.*/)", 1), target), "/"), lambda x: (x != "") & (x != "."))
    empty = F.array().cast("array<string>")
    return F.array_join(F.aggregate(parts, empty, lambda acc, x: F.when((x == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))), "/")


# Packages that are never a file of the tree.
PACKAGES = ("rxjs", "lodash", "moment", "axios")


def symbols_of(entities: DataFrame) -> DataFrame:
    """(key, id, weight, ord): every key under which an entity can be named, with its kind before the name.

    Weight prefers members of a class and a module; ties go to the first path and ordinal.
    """
    kind = F.when(F.col("type").isin("Function", "Method", "Constructor", "ArrowFunction", "GeneratorFunction", "Getter", "Setter"), "function")
    kind = kind.when(F.col("type") == "Class", "class").when(F.col("type") == "Interface", "interface").when(F.col("type") == "Variable", "variable")
    owner = entities.filter("type = 'Class'").select(F.col("id").alias("_class"), F.col("name").alias("_owner"))
    named = entities.withColumn("_class", F.element_at("props", "class_id")).join(owner, "_class", "left").withColumn("_kind", kind)
    stem = F.regexp_replace("file_path", r"\.[^./]*$", "")
    module = F.replace(stem, F.lit("/"), F.lit("."))
    script = (F.col("type") == "File") & F.col("file_path").rlike(r"\.(m|c)?[jt]sx?$")
    weight = F.when(F.col("_owner").isNotNull(), 2).otherwise(0) + F.when(F.element_at("props", "module_id").isNotNull(), 1).otherwise(0)
    groups = [
        F.when(F.col("_kind").isNotNull(), F.array(F.concat("_kind", F.lit(":"), "name"), F.concat("_kind", F.lit(":"), module, F.lit("."), "name"), F.concat(F.lit("name:"), F.col("name")))),
        F.when(F.col("_owner").isNotNull(), F.array(F.concat("_kind", F.lit(":"), "_owner", F.lit("."), "name"))),
        F.when(F.col("type") == "File", F.array(F.concat(F.lit("file:"), "file_path"))),
        F.when(script, F.array(F.concat(F.lit("file:"), stem), F.concat(F.lit("file:"), F.regexp_replace(stem, "/index$", "")))),
        # A module is known by every dotted suffix of its path.
        F.when(script | (F.col("type") == "File") & F.col("file_path").endswith(".py"), F.transform(suffix_keys(F.regexp_replace(module, r"\.__init__$", "")), lambda k: F.concat(F.lit("module:"), k))),
        F.when(F.col("file_path").rlike(r"(?i)\.html?$") & (F.col("type") == "File"), _asset_keys("template")),
        F.when(F.col("file_path").rlike(r"(?i)\.(c|sc|sa)ss$") & (F.col("type") == "File"), _asset_keys("style")),
        F.when(F.col("type").isin("AngularComponent", "AngularService", "AngularDirective"), F.array(F.concat(F.lit("angular:"), "type", F.lit(":"), "name"))),
        F.when(F.col("type") == "AngularComponent", F.array(F.concat(F.lit("selector:"), F.try_element_at("props", F.lit("selector"))), F.concat(F.lit("angular:"), "type", F.lit(":"), F.try_element_at("props", F.lit("class_name"))))),
    ]
    every = F.array_distinct(F.concat(*[F.coalesce(g, F.array().cast("array<string>")) for g in groups]))
    return named.select(F.explode(every).alias("key"), "id", weight.alias("weight"), F.struct("file_path", "ordinal").alias("ord")).filter("key IS NOT NULL")


def _candidates(end, path) -> F.Column:
    """Keys that an unresolved end may mean, best first: as written, then ever shorter suffixes; for a file also with
    the usual suffixes; for a name without dots also in the module at hand."""
    kind, name = F.regexp_extract(end, r"^\?([a-z]+):", 1), F.regexp_replace(end, r"^\?[a-z]+:", "")
    module = F.replace(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit("/"), F.lit("."))
    typed = F.transform(F.concat(F.array(F.concat(module, F.lit("."), name)), suffix_keys(name)), lambda k: F.concat(kind, F.lit(":"), k))
    files = F.array(*[F.concat(F.lit("file:"), name, F.lit(x)) for x in ("", ".ts", ".tsx", ".js", ".scss", ".css", "/index.ts", "/index.js")])
    other = F.array(F.concat(kind, F.lit(":"), name))
    none = F.array().cast("array<string>")
    package = (kind == "module") & path.rlike(r"\.(m|c)?[jt]sx?$") & (name.startswith("@") | name.isin(*PACKAGES) | name.startswith("node_modules"))
    # A template or style sheet: beside the file that names it, as written, without ./, by its name, with ./
    bare = F.regexp_replace(name, r"^\./", "")
    places = F.array(_beside(path, name), name, bare, F.element_at(F.split(name, "/"), -1), F.concat(F.lit("./"), bare))
    tails = ("", ".scss", ".css", ".sass")
    assets = F.flatten(F.transform(F.array_distinct(places), lambda p: F.flatten(F.array(*[F.array(F.concat(kind, F.lit(":"), p, F.lit(x)), F.concat(F.lit("file:"), p, F.lit(x))) for x in tails]))))
    return F.when(kind == "file", files).when(package, none).when(kind.isin("template", "style"), assets).when(kind.isin("module", "selector", "name"), other).otherwise(typed)


def references_of(links: DataFrame) -> DataFrame:
    """(end, file_path, candidates) of every end of links that is still to be resolved, once each."""
    ends = links.select(F.explode(F.array("source", "target")).alias("end"), "file_path").filter(F.col("end").startswith("?")).distinct()
    return ends.withColumn("candidates", _candidates(F.col("end"), F.col("file_path")))


def resolve_links(links: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, dropped). edges: rel_type, from_label, to_label, src, dst, props, file_path, ordinal: both ends known and a
    pair of labels that the type allows (or the type has no fixed pair). dropped: links with an end that no symbol
    answers."""
    known = resolve(references_of(links).select(F.struct("end", "file_path").alias("ref"), "candidates"), symbols_of(entities))
    known = known.select(F.col("ref.end").alias("_end"), F.col("ref.file_path").alias("_path"), F.col("id").alias("_id"))
    out = links
    for column in ("source", "target"):
        found = known.select(F.col("_end").alias(column), F.col("_path").alias("file_path"), "_id")
        out = out.join(found, [column, "file_path"], "left").withColumn(f"_{column}", F.when(F.col(column).startswith("?"), F.col("_id")).otherwise(F.col(column))).drop("_id")
    label = entities.select("id", "type")
    typed = out.join(label.select(F.col("id").alias("_source"), F.col("type").alias("from_label")), "_source", "left").join(label.select(F.col("id").alias("_target"), F.col("type").alias("to_label")), "_target", "left")
    good = F.col("from_label").isNotNull() & F.col("to_label").isNotNull()
    edges = typed.filter(good).select("rel_type", "from_label", "to_label", F.col("_source").alias("src"), F.col("_target").alias("dst"), "props", "file_path", "ordinal")
    dropped = typed.filter(~good).select("rel_type", "source", "target", "file_path", "ordinal")
    return edges, dropped


# Labels of what no file defines, by the kind of name.
EXTERNAL = {"module": "ExternalModule", "name": "ExternalSymbol", "variable": "ExternalProperty", "template": "ExternalTemplate", "style": "ExternalStyle"}


def external_stubs(dropped: DataFrame) -> DataFrame:
    """An entity for each name that no file defines, once for each label: functions that are called, and modules, symbols,
    properties, templates and style sheets; other names are references."""
    kind, name = F.regexp_extract("target", r"^\?([a-z]+):", 1), F.regexp_replace("target", r"^\?[a-z]+:", "")
    label = F.when(F.col("rel_type") == "CALLS", "ExternalFunction")
    for k, v in EXTERNAL.items():
        label = label.when(kind == k, v)
    rows = dropped.filter(F.col("target").startswith("?")).select(label.otherwise("ExternalReference").alias("type"), sanitised(name).alias("name"), name.alias("whole")).distinct()
    owner = F.when(F.col("whole").contains("."), F.substring_index("whole", ".", 1))
    return rows.select(
        F.sha2(F.concat_ws(":", "type", "whole").cast("binary"), 256).alias("id"), "name", "type",
        F.map_filter(F.create_map(F.lit("object_name"), owner, F.lit("reference_name"), F.col("whole"), F.lit("stub"), F.lit("true")), lambda k, v: v.isNotNull()).alias("props"),
    )


def label_view(entities: DataFrame, label: str) -> DataFrame:
    """The typed columns of one label; file_path beside them."""
    kinds = {"b": "boolean", "n": "long", "s": "string"}
    columns = []
    for item in f"{NODE_COLUMNS[label]} {MORE_COLUMNS.get(label, '')}".split():
        name, kind = item.split(":")
        own = F.col(name) if name in ("line_start", "line_end") else F.coalesce(F.try_element_at("props", F.lit(name)), F.col("file_path") if name == "path" else F.lit(None))
        columns.append(own.cast(kinds[kind]).alias(name))
    return entities.filter(F.col("type") == label).select("id", "name", *columns, "file_path")


def rel_view(edges: DataFrame, name: str) -> DataFrame:
    kinds = {"b": "boolean", "n": "long", "s": "string"}
    own = [F.try_element_at("props", F.lit(n)).cast(kinds[k]).alias(n) for n, k in (x.split(":") for x in REL_COLUMNS.get(name, ("", "", ""))[2].split())]
    return edges.filter(F.col("rel_type") == name).select("src", "dst", *own)
