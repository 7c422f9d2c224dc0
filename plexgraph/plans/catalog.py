"""Graph catalogs: node labels and relationship types over DataFrames.

A node table has an `id`; a relationship table has `src` and `dst`, ids of the labels it joins. Aliases name several
relationship types at once (CONTAINS for all containments).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Rel:
    """A relationship type between two labels and the source of its rows."""

    name: str
    source: str
    target: str
    rows: Callable[[], DataFrame]


@dataclass
class GraphCatalog:
    nodes: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)
    rels: dict[str, list[Rel]] = field(default_factory=dict)
    aliases: dict[str, list[str]] = field(default_factory=dict)

    def add_node(self, label: str, rows: Callable[[], DataFrame]) -> None:
        self.nodes[label] = rows

    def add_rel(self, name: str, source: str, target: str, rows: Callable[[], DataFrame]) -> None:
        self.rels.setdefault(name, []).append(Rel(name, source, target, rows))

    def node(self, label: str) -> DataFrame:
        if label not in self.nodes:
            raise KeyError(f"no node label {label}")
        return self.nodes[label]()

    def variants(self, name: str | None) -> list[Rel]:
        """The relationship types that a name or alias stands for; all, if there is no name."""
        if name is None:
            return [r for k in sorted(self.rels) for r in self.rels[k]]
        if name in self.aliases:
            return [r for k in self.aliases[name] for r in self.rels.get(k, [])]
        if name not in self.rels:
            raise KeyError(f"no relationship type {name}")
        return self.rels[name]

    def edges(self, name: str) -> DataFrame:
        """src, dst and properties of one type between one pair of labels."""
        found = self.variants(name)
        if len(found) != 1:
            raise ValueError(f"{name} joins several pairs of labels; use any_edge")
        return found[0].rows()

    def any_node(self, labels: list[str] | None = None, properties: tuple[str, ...] = ()) -> DataFrame:
        """label, gid (label:id), name and the named properties of every node: null where a label does not have one, text
        where labels differ in its type."""
        rows = {x: self.node(x) for x in labels or self.nodes}
        kinds = {p: {t for r in rows.values() for c, t in r.dtypes if c == p} for p in properties if p not in ("id", "name", "label", "gid")}
        kinds = {p: t.pop() if len(t) == 1 else "string" for p, t in kinds.items() if t}

        def more(r: DataFrame) -> list:
            return [(F.col(f"`{p}`") if p in r.columns else F.lit(None)).cast(t).alias(p) for p, t in kinds.items()]

        parts = [r.select(F.lit(x).alias("label"), F.concat_ws(":", F.lit(x), F.col("id").cast("string")).alias("gid"), "name", *more(r)) for x, r in rows.items()]
        return reduce(DataFrame.unionByName, parts)

    def any_edge(self, name: str | None = None) -> DataFrame:
        """rel_type, src and dst (as label:id) of every relationship."""
        parts = [
            r.rows().select(F.lit(r.name).alias("rel_type"), F.concat_ws(":", F.lit(r.source), F.col("src").cast("string")).alias("src"), F.concat_ws(":", F.lit(r.target), F.col("dst").cast("string")).alias("dst"))
            for r in self.variants(name)
        ]
        return reduce(DataFrame.unionByName, parts)

    def tables(self) -> list[tuple[str, str]]:
        """(name, NODE or REL) of every table."""
        return [(n, "NODE") for n in sorted(self.nodes)] + [(n, "REL") for n in sorted(self.rels)]


    def columns(self) -> list[tuple[str, str, str, str]]:
        """(name, NODE or REL, column, data type) of every table, a relationship type's once."""
        out = [(n, "NODE", f.name, f.dataType.simpleString()) for n in sorted(self.nodes) for f in self.node(n).schema]
        return out + [(n, "REL", f.name, f.dataType.simpleString()) for n in sorted(self.rels) for f in self.rels[n][0].rows().schema]


# The code graph. Label and relationship names and their columns are the data model that queries name.
_KINDS = {"b": T.BooleanType(), "n": T.LongType(), "s": T.StringType()}
_LINES = "line_start:n line_end:n"
NODE_COLUMNS = {
    "File": "path:s extension:s size:n modified_time:n hash:s lines_of_code:n",
    "Module": f"file_id:s docstring:s {_LINES}",
    "Class": f"file_id:s module_id:s docstring:s {_LINES} is_abstract:b",
    "Function": f"file_id:s module_id:s class_id:s docstring:s {_LINES} signature:s return_type:s is_async:b is_generator:b is_property:b is_staticmethod:b is_classmethod:b complexity:n",
    "Variable": "file_id:s scope_id:s type_annotation:s line_number:n is_global:b is_constant:b",
    "Import": "file_id:s module_name:s alias:s line_number:n is_from_import:b",
    "Method": f"file_id:s class_id:s docstring:s {_LINES} signature:s return_type:s is_async:b is_static:b accessibility:s",
    "Interface": f"file_id:s docstring:s {_LINES} property_count:n method_count:n",
    "Type": f"file_id:s {_LINES} type_definition:s",
    "Enum": f"file_id:s {_LINES} values:s",
    "Export": "file_id:s line_number:n export_type:s is_default:b",
    "ArrayPattern": f"file_id:s {_LINES} pattern_type:s",
    "Constructor": f"file_id:s class_id:s {_LINES} signature:s accessibility:s",
    "Getter": f"file_id:s class_id:s {_LINES} return_type:s accessibility:s",
    "Setter": f"file_id:s class_id:s {_LINES} parameter_type:s accessibility:s",
    "Decorator": f"file_id:s {_LINES} decorator_name:s arguments:s",
    "AngularComponent": f"file_id:s {_LINES} selector:s template_url:s style_url:s standalone:b imports:s",
    "AngularService": f"file_id:s {_LINES} provided_in:s",
    "AngularDirective": f"file_id:s {_LINES} selector:s standalone:b",
    "AngularPipe": f"file_id:s {_LINES} pipe_name:s standalone:b",
    "AngularModule": f"file_id:s {_LINES} declarations:s imports:s exports:s providers:s",
    "AngularInput": f"file_id:s {_LINES} input_name:s required:b",
    "AngularOutput": f"file_id:s {_LINES} output_name:s event_type:s",
    "ArrowFunction": f"file_id:s {_LINES} signature:s return_type:s is_async:b",
    "GeneratorFunction": f"file_id:s {_LINES} signature:s return_type:s is_async:b",
    "ExternalProperty": "file_id:s object_name:s property_path:s line_number:n",
    "ExternalFunction": "file_id:s object_name:s line_number:n",
}
#: What parsers tell of an entity beyond those columns; views have these after them.
_PARAMETERS = "parameters:s parameter_count:n has_destructuring:b has_defaults:b has_rest_params:b has_type_annotations:b"
_MORE = {
    "File": "language:s framework:s template_type:s angular_directives:s custom_components:s material_components:s property_bindings:n event_bindings:n interpolations:n "
    "style_type:s is_component_style:b selector_count:n selectors:s rule_count:n import_count:n imports:s scss_variables:s variable_count:n mixins:s mixin_count:n "
    "functions:s function_count:n max_nesting_depth:n host_selectors:n deep_selectors:n",
    "Class": "extends:s method_count:n property_count:n",
    "Function": f"{_PARAMETERS} function_style:s is_arrow:b",
    "ArrowFunction": f"{_PARAMETERS} function_style:s is_arrow:b",
    "GeneratorFunction": f"{_PARAMETERS} function_style:s is_arrow:b",
    "Method": f"{_PARAMETERS} method_kind:s",
    "Constructor": _PARAMETERS,
    "Variable": "declaration_type:s has_destructuring:b has_template_literal:b has_spread_operator:b is_object_literal:b has_array_syntax:b "
    "is_arrow_function_assignment:b is_function_assignment:b is_async_assignment:b modern_js_complexity:n",
    "Import": "is_relative:b is_default:b is_namespace:b",
    "AngularComponent": "template:s has_inline_styles:b class_name:s",
    "AngularModule": "has_declarations:b has_imports:b has_exports:b has_providers:b",
}
MORE_COLUMNS = {label: " ".join(filter(None, (_MORE.get(label, ""), "code_snippet:s"))) for label in NODE_COLUMNS if label not in ("File", "Module")} | {"File": _MORE["File"]}
REL_COLUMNS = {
    "CALLS": ("Function", "Function", "call_type:s line_number:n"),
    "IMPORTS": ("File", "File", "import_type:s"),
    "INHERITS": ("Class", "Class", ""),
    "USES": ("Function", "Variable", "usage_type:s line_number:n"),
    "DECORATES": ("Function", "Function", "decorator_name:s line_number:n"),
    "EXPORTS": ("File", "Export", "export_type:s symbol:s"),
    "ACCESSES": ("Function", "Variable", "property_path:s access_location:n"),
    "IMPLEMENTS": ("Class", "Interface", ""),
    "EXTENDS": ("Class", "Class", ""),
    "USES_TEMPLATE": ("AngularComponent", "File", "template_path:s resolved_path:s component_selector:s"),
    "USES_STYLES": ("AngularComponent", "File", "style_path:s resolved_path:s component_selector:s"),
}
#: Containments, by rule: the holder and the labels that it may hold.
CONTAINMENTS = {
    "File": [x for x in NODE_COLUMNS if x != "File"],
    "Module": ["Class", "Function", "Variable"],
    "Class": ["Function", "Variable", "Class", "Method", "Constructor", "Getter", "Setter"],
    "Function": ["Variable", "Function"],
}
for _holder, _held in CONTAINMENTS.items():
    for _label in _held:
        REL_COLUMNS[f"{_holder}_CONTAINS_{_label}".upper()] = (_holder, _label, "")


def _fields(text: str) -> list[T.StructField]:
    return [T.StructField(n, _KINDS[k]) for n, k in (x.split(":") for x in text.split())]


def node_schema(label: str) -> T.StructType:
    """Stored columns of a label; file_path is kept beside file_id on all labels, so that queries need no join."""
    return T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), *_fields(NODE_COLUMNS[label]), *_fields(MORE_COLUMNS.get(label, "")), T.StructField("file_path", T.StringType())])


def rel_schema(name: str) -> T.StructType:
    return T.StructType([T.StructField("src", T.StringType()), T.StructField("dst", T.StringType()), *_fields(REL_COLUMNS[name][2])])


def contains_types() -> list[str]:
    return sorted(x for x in REL_COLUMNS if "_CONTAINS_" in x)
