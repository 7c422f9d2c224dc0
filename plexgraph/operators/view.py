"""What a graph display asks for: filters, neighbours, labels, level of detail, what lies in a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Zoom levels and what they show.
FAR, NEAR = 0.3, 0.7
FAR_TYPES = ("File", "Class")
DIMMED = ("Variable",)
# Colour and size of a node by type.
COLOURS = {"File": "#8b5cf6", "Module": "#06b6d4", "Class": "#10b981", "Function": "#f59e0b", "Variable": "#ef4444", "Import": "#6b7280"}
SIZES = {"File": 20, "Module": 18, "Class": 16, "Function": 14, "Variable": 12, "Import": 10}
#: What other types get.
COLOUR, SIZE = "#6b7280", 10
# Rows of a chunk, and how many nodes there must be for chunks.
CHUNK, CHUNKED = 1000, 5000


def filtered(nodes: DataFrame, types: tuple[str, ...] = (), search: str = "", path: str = "", kind: str = "type", name: str = "name", file: str = "file_path") -> DataFrame:
    """Nodes of the types (in any case) whose name or path contains the search text, under a part of a path."""
    out = nodes
    if types:
        out = out.filter(F.lower(kind).isin(*[t.lower() for t in types]))
    if search:
        out = out.filter(F.lower(name).contains(search.lower()) | (F.lower(file).contains(search.lower()) if file in nodes.columns else F.lit(False)))
    if path:
        out = out.filter(F.col(file).contains(path))
    return out


def neighbours(edges: DataFrame, node) -> DataFrame:
    """Edges that touch a node."""
    return edges.filter((F.col("src") == node) | (F.col("dst") == node))


def relation_label(kind: Column) -> Column:
    """How a relationship type is written on an edge: containments as one word, others in lower case."""
    return F.when(kind.contains("_CONTAINS_"), "contains").otherwise(F.replace(F.lower(kind), F.lit("_"), F.lit(" ")))


def short_label(name: Column) -> Column:
    """Names of more than 15 characters keep 12 and three dots."""
    return F.when(F.length(name) > 15, F.concat(F.substring(name, 1, 12), F.lit("..."))).otherwise(name)


def level_of_detail(nodes: DataFrame, zoom: float, kind: str = "type") -> DataFrame:
    """Far away only files and classes; at middle distance all, some dimmed."""
    out = nodes.filter(F.col(kind).isin(*FAR_TYPES)) if zoom < FAR else nodes
    return out.withColumn("dimmed", F.col(kind).isin(*DIMMED) if zoom < NEAR else F.lit(False))


def bounds(nodes: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return nodes.agg(F.min(x).alias("min_x"), F.max(x).alias("max_x"), F.min(y).alias("min_y"), F.max(y).alias("max_y"))


def in_window(nodes: DataFrame, edges: DataFrame, box: tuple[float, float, float, float], key: str = "id", x: str = "x", y: str = "y") -> tuple[DataFrame, DataFrame]:
    """Nodes inside (left, top, right, bottom), and edges with either end inside."""
    left, top, right, bottom = box
    seen = nodes.filter(F.col(x).between(left, right) & F.col(y).between(top, bottom))
    ends = seen.select(F.col(key).alias("__end"), F.lit(True).alias("__in"))
    a = edges.join(ends.withColumnsRenamed({"__end": "src", "__in": "__a"}), "src", "left")
    b = a.join(ends.withColumnsRenamed({"__end": "dst", "__in": "__b"}), "dst", "left")
    return seen, b.filter("__a OR __b").drop("__a", "__b").select(*edges.columns)


def styled(nodes: DataFrame, kind: str = "type") -> DataFrame:
    """nodes with colour and size by type."""

    def of(table: dict, other):
        out = F.when(F.lit(False), F.lit(other))
        for k, v in table.items():
            out = out.when(F.col(kind) == k, F.lit(v))
        return out.otherwise(F.lit(other))

    return nodes.withColumns({"colour": of(COLOURS, COLOUR), "size": of(SIZES, SIZE)})


def chunked(rows: DataFrame, key: str = "id", chunk: int = CHUNK, least: int = CHUNKED) -> DataFrame:
    """rows with the number of the chunk in which a display loads them, by key; all 0 up to `least` rows. Rows are ranked
    in ranges of the key, whose counts alone meet."""
    if rows.count() <= least:
        return rows.withColumn("chunk", F.lit(0).cast("long"))
    parts = rows.repartitionByRange(F.col(key)).withColumn("__part", F.spark_partition_id())
    from plexgraph.storage import stash

    parts = stash(parts, "view-ranges")
    counts = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    counts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(key)) - 1
    return parts.join(F.broadcast(counts), "__part").withColumn("chunk", F.floor((place + F.col("__before")) / chunk).cast("long")).drop("__part", "__before")
