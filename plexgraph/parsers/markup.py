"""Templates and style sheets: their features, as columns name them too (functions/text.py), and their links."""

from __future__ import annotations

import re

from plexgraph.functions import text as X
from plexgraph.parsers.records import Parsed, file_entity, relative


def _kinds(pattern: str, text: str) -> list[str]:
    return sorted(set(re.findall(pattern, text)))


def _nesting(text: str) -> int:
    depth = most = 0
    for c in re.findall(r"[{}]", text):
        depth = depth + 1 if c == "{" else max(0, depth - 1)
        most = max(most, depth)
    return most


def html_props(text: str) -> dict:
    """What the File entity of a template tells of it; bindings are counted for Angular templates only."""
    angular = any(re.search(p, text) for p in X.ANGULAR_TEMPLATE)
    kind = "angular" if angular else "html"
    props = {"language": "html", "framework": "angular" if angular else None, "is_template": True, "template_type": kind}
    if angular:
        props |= {"angular_directives": _kinds(X.DIRECTIVE, text), "custom_components": _kinds(X.APP_TAG, text), "material_components": _kinds(X.MATERIAL_TAG, text)}
        props |= {name: len(re.findall(p, text)) for name, p in (("property_bindings", X.PROPERTY_BINDING), ("event_bindings", X.EVENT_BINDING), ("interpolations", X.INTERPOLATION))}
    return props


def style_type(path: str, text: str) -> str:
    suffix = path.rpartition(".")[2]
    return suffix if suffix in ("scss", "sass") else "scss" if suffix == "css" and re.search(X.SCSS, text) else "css"


def style_imports(kind: str, text: str) -> list[tuple[str, str]]:
    """(word, target) of each import; those of modules in SCSS only."""
    words = (("import", X.IMPORT), *((("use", X.USE), ("forward", X.FORWARD)) if kind == "scss" else ()))
    return [(word, target) for word, p in words for target in re.findall(p, text)]


def style_props(path: str, text: str) -> dict:
    """What the File entity of a style sheet tells of it."""
    kind = style_type(path, text)
    marked = any(re.search(p, text) for p in X.ANGULAR_STYLE)
    angular = marked or ".component." in path
    selectors, imports = _kinds(X.SELECTOR, re.sub(X.COMMENT, "", text)), [t for _, t in style_imports(kind, text)]
    props = {
        "language": kind, "framework": "angular" if angular else None, "is_stylesheet": True, "style_type": kind, "is_component_style": angular,
        "selector_count": len(selectors), "selectors": selectors[: X.MOST_SELECTORS], "rule_count": len(re.findall(X.RULE, text)), "import_count": len(imports), "imports": imports,
    }
    if kind == "scss":
        found = _kinds(X.VARIABLE, text)
        props |= {"scss_variables": found, "variable_count": len(found)}
    if kind != "css":
        mixins, functions = _kinds(X.MIXIN, text), _kinds(X.FUNCTION, text)
        props |= {"mixins": mixins, "mixin_count": len(mixins), "functions": functions, "function_count": len(functions), "max_nesting_depth": _nesting(text)}
    if marked:
        props |= {"host_selectors": text.count(":host"), "deep_selectors": text.count("::ng-deep"), "material_components": _kinds(X.MATERIAL, text)}
    return props


def parse_html(path: str, text: str) -> Parsed:
    out = Parsed(path)
    file = file_entity(out, text, text.count("\n") + 1, **html_props(text))
    for tag in _kinds(X.APP_TAG, text):
        out.link(file.id, f"?selector:{tag}", "USES_COMPONENT", component_tag=tag, usage_type="template_reference")
    return out


def parse_css(path: str, text: str) -> Parsed:
    out = Parsed(path)
    file = file_entity(out, text, text.count("\n") + 1, **style_props(path, text))
    # Imports in comments are counted with the text's features, but lead nowhere.
    for word, target in style_imports(style_type(path, text), re.sub(X.COMMENT, "", text)):
        out.link(file.id, f"?style:{target}", "IMPORTS_STYLE", import_type=word, import_path=target)
    return out
