"""Source discovery: a binary file scan, filtered before contents are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexgraph.functions.text import glob_regex

# Suffixes and the file types that they mean, in the order of test.
FILE_TYPES = (
    (".component.ts", "angular"), (".module.ts", "angular"), (".service.ts", "angular"), (".guard.ts", "angular"), (".pipe.ts", "angular"),
    (".component.html", "angular_template"), (".component.css", "angular_style"), (".component.scss", "angular_style"), (".component.sass", "angular_style"),
    (".py", "python"), (".pyw", "python"), (".pyi", "python"), (".js", "javascript"), (".jsx", "javascript"), (".mjs", "javascript"), (".ts", "typescript"), (".tsx", "typescript"),
    (".html", "html"), (".htm", "html"), (".css", "css"), (".scss", "css"), (".sass", "css"), (".json", "json"), (".yml", "yaml"), (".yaml", "yaml"), (".md", "markdown"),
)
#: Types that have a parser.
PARSED = ("python", "javascript", "typescript", "angular", "angular_template", "angular_style", "html", "css")
# Shell patterns of what is not read.
EXCLUDED = (
    "__pycache__", "*.pyc", ".git", "node_modules", ".env", "venv", "env", "dist", "build", ".next", "coverage", "out", ".turbo",
    "*/dist/*", "*/build/*", "*/.angular/*", "*/.next/*", "*/coverage/*", "*/out/*", "*/.turbo/*",
    "*/lib/*", "*/esm/*", "*/umd/*", "*/.cache/*", "*/target/*", "*/.gradle/*", "*/.mvn/*", "*/bin/*", "*/obj/*",
)
MAX_FILE_SIZE = 1 << 20


def file_type(path: Column) -> Column:
    """The type of a path by its suffix, in lower case; Dockerfile by name; null for others."""
    p = F.lower(path)
    out = F.when(F.lit(False), F.lit(""))
    for suffix, kind in FILE_TYPES:
        out = out.when(p.endswith(suffix), kind)
    return out.when(F.element_at(F.split(p, "/"), -1) == "dockerfile", "dockerfile")


def excluded(path: Column, patterns: tuple[str, ...] = EXCLUDED) -> Column:
    """Whether the path from the root (with and without a leading slash), or any part of it, matches a shell pattern. All
    patterns are one regular expression."""
    any_of = "|".join(f"(?:{glob_regex(p)})" for p in patterns) or "(?!)"
    return path.rlike(any_of) | F.concat(F.lit("/"), path).rlike(any_of) | F.exists(F.split(path, "/"), lambda part: part.rlike(any_of))


def scan(
    spark: SparkSession, root: str, patterns: tuple[str, ...] = EXCLUDED, max_file_size: int = MAX_FILE_SIZE, types: tuple[str, ...] = PARSED, paths: list[str] | None = None
) -> DataFrame:
    """path (from root), name, extension, file_type, size, modified_time, hash, text and raw of every file to parse.

    Size and path filters stand on the scan, so contents of other files are not read. paths: these files only. A file
    whose bytes are not UTF-8 has no text; raw has its bytes, and is null for all others.
    """
    base = root.removeprefix("file://").rstrip("/") + "/"
    head = "file://" if root.startswith("file://") else ""
    reader = spark.read.format("binaryFile")
    found = reader.option("recursiveFileLookup", True).load(root) if paths is None else reader.load([head + base + p for p in paths])
    full = F.regexp_replace(F.col("path"), "^file:(//)?", "")
    rows = found.filter(F.col("length") <= max_file_size).withColumn("path", F.when(full.startswith(base), F.substring(full, len(base) + 1, 1 << 30)).otherwise(full))
    rows = rows.withColumn("file_type", file_type(F.col("path"))).filter(F.col("file_type").isin(*types) & ~excluded(F.col("path"), patterns))
    name = F.element_at(F.split("path", "/"), -1)
    text = F.col("content").cast("string")
    return rows.select(
        "path", name.alias("name"), F.regexp_extract(name, r"(\.[^.]*)$", 1).alias("extension"), "file_type", F.col("length").alias("size"),
        F.unix_seconds("modificationTime").alias("modified_time"), F.sha2("content", 256).alias("hash"),
        F.when(F.is_valid_utf8(text), text).alias("text"), F.when(~F.is_valid_utf8(text), F.col("content")).alias("raw"),
    )


def python_files(spark: SparkSession, root: str, patterns: tuple[str, ...] = EXCLUDED, max_file_size: int = MAX_FILE_SIZE, extensions: tuple[str, ...] = (".py",)) -> DataFrame:
    """The paths of all Python files, or files of other suffixes, in order. Contents are not read."""
    every = tuple(dict.fromkeys(kind for _, kind in FILE_TYPES))
    found = scan(spark, root, patterns, max_file_size, every).filter(F.col("extension").isin(*extensions))
    return found.select("path").orderBy("path")


def tree(files: DataFrame) -> DataFrame:
    """path, parent, depth, kind and size of every folder and file; a folder's size is that of all files below."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("path"), i.alias("depth"), (i == F.size(parts)).alias("leaf")))
    rows = files.select("size", F.explode(prefixes).alias("p"))
    return rows.groupBy(F.col("p.path").alias("path"), F.col("p.depth").alias("depth")).agg(F.when(F.max("p.leaf"), "file").otherwise("folder").alias("kind"), F.sum("size").alias("size")).withColumn(
        "parent", F.regexp_replace(F.col("path"), "/?[^/]*$", "")
    )
