"""Source parsers: (path, text) to entities and relationships. Pure Python, safe in a worker.

A parser is a function (path, text) -> Parsed. REGISTRY maps file types to parsers; register() adds one.
"""

from __future__ import annotations

from collections.abc import Callable

from plexgraph.parsers.records import Parsed

REGISTRY: dict[str, Callable[[str, str], Parsed]] = {}


def register(file_type: str, parser: Callable[[str, str], Parsed]) -> None:
    REGISTRY[file_type] = parser


def parse(path: str, text: str, file_type: str) -> Parsed:
    """Parse one file. A parser that fails gives one error and no entities."""
    parser = REGISTRY.get(file_type)
    if parser is None:
        return Parsed(path)
    try:
        return parser(path, text)
    except Exception as e:  # one bad file must not fail the task
        return Parsed(path, errors=[f"{type(e).__name__}: {e}"])


from plexgraph.parsers import markup, python, script  # noqa: E402

register("python", python.parse)
for _t in ("javascript", "typescript", "angular"):
    register(_t, script.parse)
for _t in ("html", "angular_template"):
    register(_t, markup.parse_html)
for _t in ("css", "scss", "sass", "angular_style"):
    register(_t, markup.parse_css)
