"""Python sources: modules, classes, functions, variables, imports; calls, inheritance, decoration, containment.

The tree is walked once. A function's complexity and whether it yields are counted on the way, and an enclosing function
adds what its inner ones have counted.
"""

from __future__ import annotations

import ast
import posixpath

from plexgraph.parsers.records import Entity, Parsed, file_entity

#: Nodes that add a path through a function.
_BRANCHES = frozenset((ast.If, ast.While, ast.For, ast.AsyncFor, ast.ExceptHandler, ast.With, ast.AsyncWith))
_LEAVES = frozenset((ast.Name, ast.Constant, ast.Load, ast.Store, ast.Del, ast.Pass, ast.Break, ast.Continue, ast.Global, ast.Nonlocal))
_YIELDS = frozenset((ast.Yield, ast.YieldFrom))
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def dotted(node: ast.AST | None) -> str:
    """The name of a chain of attributes; a constant counts as its text; what has no name of its own adds nothing."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        parts.append(node.id)
    elif isinstance(node, ast.Constant):
        parts.append(str(node.value))
    return ".".join(x for x in reversed(parts) if x)


def signature(node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    """(args): positional arguments with the names of their annotations, *args and **kwargs."""

    def shown(a: ast.arg, mark: str = "") -> str:
        return mark + a.arg + (f": {dotted(a.annotation)}" if a.annotation else "")

    a = node.args
    args = [shown(x) for x in a.args] + ([shown(a.vararg, "*")] if a.vararg else []) + ([shown(a.kwarg, "**")] if a.kwarg else [])
    return f"({', '.join(args)})"


def _doc(node: ast.AST) -> str | None:
    first = node.body[0] if node.body else None
    return first.value.value if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str) else None


def _inferred(value: ast.AST) -> str:
    if isinstance(value, ast.Constant):
        return type(value.value).__name__
    for kind, name in ((ast.List, "list"), (ast.Dict, "dict"), (ast.Set, "set"), (ast.Tuple, "tuple")):
        if isinstance(value, kind):
            return name
    return (dotted(value.func) if isinstance(value, ast.Call) else "") or "unknown"


def _targets(node: ast.AST) -> list[str]:
    """The names that an assignment binds, inside tuples and lists of any depth."""
    if isinstance(node, (ast.Tuple, ast.List)):
        return [name for x in node.elts for name in _targets(x)]
    return [node.id] if isinstance(node, ast.Name) else []


class _Walk:
    def __init__(self, out: Parsed, file: Entity, module: Entity):
        self.out, self.file, self.module = out, file, module
        self.classes: list[Entity] = []
        self.functions: list[Entity] = []
        self.branches, self.yields = 0, False
        self.scope = module.name
        self.handlers = {
            ast.ClassDef: self.class_, ast.FunctionDef: self.function, ast.AsyncFunctionDef: self.function,
            ast.Import: self.import_, ast.ImportFrom: self.import_from, ast.Call: self.call, ast.Assign: self.assign,
        }

    def walk(self, node: ast.AST) -> None:
        kind = node.__class__
        if kind in _LEAVES:
            return
        if kind in _BRANCHES:
            self.branches += 1
        elif kind is ast.BoolOp:
            self.branches += len(node.values) - 1
        elif kind in _YIELDS:
            self.yields = True
        handler = self.handlers.get(kind)
        if handler:
            handler(node)
        else:
            self.inner(node)

    def inner(self, node: ast.AST) -> None:
        for name in node._fields:
            value = getattr(node, name, None)
            if value.__class__ is list:
                for x in value:
                    if isinstance(x, ast.AST):
                        self.walk(x)
            elif isinstance(value, ast.AST):
                self.walk(value)

    def named(self, name: str, node: ast.AST) -> None:
        """Walk what is inside a class or function, whose name is part of the scope there."""
        scope, self.scope = self.scope, f"{self.scope}:{name}"
        self.inner(node)
        self.scope = scope

    def class_(self, node: ast.ClassDef) -> None:
        bases = [b for b in map(dotted, node.bases) if b]
        decorated = (dotted(d) for m in node.body if isinstance(m, _FUNCTIONS) for d in m.decorator_list)
        abstract = any(b in ("ABC", "abc.ABC") for b in bases) or any(d.split(".")[-1] == "abstractmethod" for d in decorated)
        c = self.out.entity(node.name, "Class", node.lineno, node.end_lineno or node.lineno, self.scope, docstring=_doc(node), is_abstract=abstract, file_id=self.file.id, module_id=self.module.id)
        if self.classes:
            self.out.link(self.classes[-1].id, c.id, "CLASS_CONTAINS_CLASS")
        else:
            self.out.link(self.module.id, c.id, "MODULE_CONTAINS_CLASS")
            self.out.link(self.file.id, c.id, "FILE_CONTAINS_CLASS")
        for b in bases:
            self.out.link(c.id, f"?class:{b}", "INHERITS")
        self.classes.append(c)
        functions, self.functions = self.functions, []
        self.named(node.name, node)
        self.functions = functions
        self.classes.pop()

    def function(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        marks = [d for d in map(dotted, node.decorator_list) if d]
        f = self.out.entity(
            node.name, "Function", node.lineno, node.end_lineno or node.lineno, self.scope,
            docstring=_doc(node), signature=signature(node), return_type=dotted(node.returns), is_async=isinstance(node, ast.AsyncFunctionDef),
            is_property="property" in marks, is_staticmethod="staticmethod" in marks, is_classmethod="classmethod" in marks,
            file_id=self.file.id, module_id=self.module.id, class_id=self.classes[-1].id if self.classes else None,
        )
        if self.classes:
            self.out.link(self.classes[-1].id, f.id, "CLASS_CONTAINS_FUNCTION")
        elif self.functions:
            self.out.link(self.functions[-1].id, f.id, "FUNCTION_CONTAINS_FUNCTION")
        else:
            self.out.link(self.module.id, f.id, "MODULE_CONTAINS_FUNCTION")
            self.out.link(self.file.id, f.id, "FILE_CONTAINS_FUNCTION")
        for d in marks:
            self.out.link(f"?function:{d}", f.id, "DECORATES", decorator_name=d, line_number=node.lineno)
        branches, yields = self.branches, self.yields
        self.branches, self.yields = 0, False
        self.functions.append(f)
        self.named(node.name, node)
        self.functions.pop()
        f.props["complexity"], f.props["is_generator"] = str(1 + self.branches), "true" if self.yields else "false"
        self.branches, self.yields = self.branches + branches, self.yields or yields

    def imported(self, node: ast.stmt, name: str, module: str, goal: str, alias: str | None, from_: bool) -> None:
        i = self.out.entity(name, "Import", node.lineno, node.lineno, self.scope, module_name=module, alias=alias, is_from_import=from_, line_number=node.lineno, file_id=self.file.id)
        self.out.link(self.file.id, i.id, "FILE_CONTAINS_IMPORT")
        if goal:
            # From the file, and from the import itself: queries follow either.
            for end in (self.file.id, i.id):
                self.out.link(end, f"?module:{goal}", "IMPORTS", import_type="from" if from_ else "import")

    def import_(self, node: ast.Import) -> None:
        for a in node.names:
            self.imported(node, a.asname or a.name, a.name, a.name, a.asname, False)

    def import_from(self, node: ast.ImportFrom) -> None:
        """The property has the module as written; the edge goes to the one meant, with leading dots resolved."""
        written = goal = node.module or ""
        if node.level:
            base = posixpath.dirname(self.out.path)
            for _ in range(node.level - 1):
                base = posixpath.dirname(base)
            goal = ".".join(x for x in (*base.split("/"), *written.split(".")) if x)
        for a in node.names:
            self.imported(node, a.name, written, goal, a.asname, True)

    def call(self, node: ast.Call) -> None:
        name = dotted(node.func)
        if name and self.functions:
            # self.x() and cls.x() mean a method of the class at hand, if there is one.
            own = name.split(".")
            if len(own) == 2 and own[0] in ("self", "cls") and self.classes:
                name = f"{self.classes[-1].name}.{own[1]}"
            self.out.link(self.functions[-1].id, f"?function:{name}", "CALLS", call_type="function_call", line_number=node.lineno)
        self.inner(node)

    def assign(self, node: ast.Assign) -> None:
        for name in (n for target in node.targets for n in _targets(target)):
            if name.startswith("_"):
                continue
            holder = self.functions[-1] if self.functions else self.classes[-1] if self.classes else self.module
            v = self.out.entity(
                name, "Variable", node.lineno, node.lineno, self.scope, type_annotation=_inferred(node.value), line_number=node.lineno,
                is_global=not self.functions and not self.classes, is_constant=name.isupper(), file_id=self.file.id, scope_id=holder.id,
            )
            self.out.link(holder.id, v.id, f"{holder.type.upper()}_CONTAINS_VARIABLE")
            if not self.functions:
                self.out.link(self.file.id, v.id, "FILE_CONTAINS_VARIABLE")
        self.inner(node)


def parse(path: str, text: str) -> Parsed:
    """All entities of a module; a syntax error gives one error and no entities."""
    out = Parsed(path)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as e:
        out.errors.append(f"{type(e).__name__}: {e}")
        return out
    lines = text.split("\n")
    loc = sum(1 for x in map(str.strip, lines) if x and x[0] != "#")
    file = file_entity(out, text, loc)
    stem = posixpath.splitext(posixpath.basename(path))[0]
    module = out.entity(stem, "Module", 1, len(lines), docstring=_doc(tree), file_id=file.id)
    out.link(file.id, module.id, "FILE_CONTAINS_MODULE")
    _Walk(out, file, module).inner(tree)
    return out
