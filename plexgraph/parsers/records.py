"""What a parser yields."""

from __future__ import annotations

import hashlib
import posixpath
from dataclasses import dataclass, field


@dataclass
class Entity:
    id: str
    name: str
    type: str
    line_start: int
    line_end: int
    props: dict[str, str] = field(default_factory=dict)


@dataclass
class Link:
    """A relationship. An end is an entity id, or `?kind:name` where it must be resolved against all symbols."""

    source: str
    target: str
    type: str
    props: dict[str, str] = field(default_factory=dict)


@dataclass
class Parsed:
    path: str
    entities: list[Entity] = field(default_factory=list)
    links: list[Link] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)

    def entity(self, name: str, kind: str, start: int, end: int, scope: str = "", **props) -> Entity:
        e = Entity(entity_id(self.path, scope, kind, name, start), name, kind, start, end, {k: as_text(v) for k, v in props.items() if v is not None})
        self.entities.append(e)
        return e

    def link(self, source: str, target: str, kind: str, **props) -> None:
        self.links.append(Link(source, target, kind, {k: as_text(v) for k, v in props.items() if v is not None}))


def as_text(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    return ",".join(map(str, value)) if isinstance(value, (list, tuple)) else str(value)


def entity_id(path: str, scope: str, kind: str, name: str, line: int) -> str:
    return hashlib.md5(":".join(x for x in (path, scope, kind, name, str(line)) if x).encode()).hexdigest()


def file_entity(out: Parsed, text: str, loc: int, **props) -> Entity:
    name = posixpath.basename(out.path)
    return out.entity(name, "File", 1, text.count("\n") + 1, path=out.path, extension=posixpath.splitext(name)[1], size=len(text), lines_of_code=loc, **props)


def relative(path: str, target: str) -> str:
    """A path named in a file, from the root."""
    return posixpath.normpath(posixpath.join(posixpath.dirname(path), target))
