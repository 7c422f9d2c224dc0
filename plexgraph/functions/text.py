"""Text features as column expressions: line counts, template and style sheet patterns, nesting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns that define each feature.
DIRECTIVE = r"\*ng[A-Z][a-zA-Z]*"
PROPERTY_BINDING = r"\[.*?\]"
EVENT_BINDING = r"\(.*?\)"
INTERPOLATION = r"\{\{.*?\}\}"
REFERENCE = r"#[a-zA-Z][a-zA-Z0-9]*"
MATERIAL = r"mat-[a-z-]+"
CUSTOM = r"app-[a-z-]+"
ANGULAR_TEMPLATE = (DIRECTIVE, PROPERTY_BINDING, EVENT_BINDING, INTERPOLATION, REFERENCE, MATERIAL, CUSTOM)
APP_TAG = r"<(app-[a-z-]+)"
MATERIAL_TAG = r"<(mat-[a-z-]+)"
COMMENT = r"(?s)/\*.*?\*/"
SELECTOR = r"([.#]?[a-zA-Z][a-zA-Z0-9_-]*(?:\s*[>+~]\s*[.#]?[a-zA-Z][a-zA-Z0-9_-]*)*)\s*\{"
RULE = r"\{[^}]*\}"
SCSS = r"[\$@&]|\{[^}]*\{"
ANGULAR_STYLE = (r":host", r"::ng-deep", r"@use ['\"]@angular", MATERIAL)
IMPORT, USE, FORWARD = (rf"@{w}\s+['\"]([^'\"]+)['\"]" for w in ("import", "use", "forward"))
VARIABLE = r"\$([a-zA-Z][a-zA-Z0-9_-]*)"
MIXIN, FUNCTION = (rf"@{w}\s+([a-zA-Z][a-zA-Z0-9_-]*)" for w in ("mixin", "function"))
MOST_SELECTORS = 20


def distinct_matches(text: Column, pattern: str, group: int = 1) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))


def lines_of_code(text: Column, comment: str | None = "#") -> Column:
    """Lines that are not blank and, with a comment mark, do not start with it. Null counts as empty."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")

    def counts(x: Column) -> Column:
        full = F.trim(x) != ""
        return full & ~F.trim(x).startswith(comment) if comment else full

    return F.size(F.filter(lines, counts)).cast("long")


def nesting_depth(text: Column) -> Column:
    """The deepest nesting of braces; closing braces without an opening one are passed over."""
    braces = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "[^{}]", ""), "")
    zero = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))

    def step(acc: Column, c: Column) -> Column:
        d = F.when(c == "{", acc["d"] + 1).when(c == "}", F.greatest(acc["d"] - 1, F.lit(0))).otherwise(acc["d"])
        return F.struct(d.alias("d"), F.greatest(acc["m"], d).alias("m"))

    return F.aggregate(braces, zero, step, lambda acc: acc["m"])


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def is_angular_template(text: Column) -> Column:
    return _any(text, ANGULAR_TEMPLATE)


def _sorted(text: Column, pattern: str, group: int = 1) -> Column:
    return F.array_sort(distinct_matches(text, pattern, group))


def html_features(text: Column) -> dict[str, Column]:
    """Features of a template by name; lists are distinct and in order."""
    return {
        "is_angular": is_angular_template(text),
        "directives": _sorted(text, DIRECTIVE, 0),
        "components": _sorted(text, APP_TAG),
        "material_components": _sorted(text, MATERIAL_TAG),
        "property_bindings": F.regexp_count(text, F.lit(PROPERTY_BINDING)),
        "event_bindings": F.regexp_count(text, F.lit(EVENT_BINDING)),
        "interpolations": F.regexp_count(text, F.lit(INTERPOLATION)),
    }


def style_features(text: Column, path: Column) -> dict[str, Column]:
    """Features of a style sheet by name; lists are distinct and in order, of selectors the first 20. What only
    preprocessors have, or only component styles, is empty in others."""
    kind = F.when(path.endswith(".scss"), "scss").when(path.endswith(".sass"), "sass").when(path.endswith(".css") & text.rlike(SCSS), "scss").otherwise("css")
    angular = path.contains(".component.") | _any(text, ANGULAR_STYLE)
    # The metadata of a component style are taken by its text alone.
    marked = _any(text, ANGULAR_STYLE)
    none = F.array().cast("array<string>")
    selectors = _sorted(F.regexp_replace(text, COMMENT, ""), SELECTOR)
    more = F.when(kind == "scss", F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (USE, FORWARD)])).otherwise(none)
    return {
        "css_type": kind,
        "is_angular": angular,
        "selector_count": F.size(selectors),
        "selectors": F.slice(selectors, 1, MOST_SELECTORS),
        "rules": F.regexp_count(text, F.lit(RULE)),
        "imports": F.concat(F.regexp_extract_all(text, F.lit(IMPORT), F.lit(1)), more),
        "variables": F.when(kind == "scss", _sorted(text, VARIABLE)).otherwise(none),
        "mixins": F.when(kind != "css", _sorted(text, MIXIN)).otherwise(none),
        "functions": F.when(kind != "css", _sorted(text, FUNCTION)).otherwise(none),
        "max_nesting": F.when(kind != "css", nesting_depth(text)).otherwise(0),
        "host_rules": F.when(marked, F.regexp_count(text, F.lit(":host"))).otherwise(0),
        "deep_rules": F.when(marked, F.regexp_count(text, F.lit("::ng-deep"))).otherwise(0),
        "material": F.when(marked, _sorted(text, f"({MATERIAL})")).otherwise(none),
    }


def file_info(files: DataFrame) -> DataFrame:
    """path, name, stem, extension, size, total_lines, lines_of_code and hash of files (path, text, raw bytes or null)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.regexp_extract(name, r".(\.[^.]*)$", 1)
    return files.select(
        "path", name.alias("name"), F.substring(name, F.lit(1), F.length(name) - F.length(extension)).alias("stem"), extension.alias("extension"),
        F.octet_length(text).cast("long").alias("size"), F.size(F.split(text, "\n")).cast("long").alias("total_lines"), lines_of_code(text).alias("lines_of_code"),
        F.sha2(text.cast("binary"), 256).alias("hash"),
    )


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression for a whole string."""
    out = []
    for c in pattern:
        out.append({"*": "(?s:.*)", "?": "(?s:.)"}.get(c) or (c if c.isalnum() or c in "_[]!-" else "\\" + c))
    return "^" + "".join(out).replace("[!", "[^") + "$"


def sanitised(name: Column) -> Column:
    """Names of more than 100 characters are cut to 90, or at a dot among the last ten of those, and get a mark and a
    short hash of the whole; an empty name is unknown."""
    head = F.substring(name, 1, 90)
    cut = F.when(F.substring(head, 81, 10).contains("."), F.regexp_replace(head, r"\.[^.]*$", "")).otherwise(head)
    return F.when(F.coalesce(name, F.lit("")) == "", "unknown").when(F.length(name) > 100, F.concat(cut, F.lit("..."), F.substring(F.md5(name.cast("binary")), 1, 8))).otherwise(name)
