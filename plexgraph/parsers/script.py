"""JavaScript, TypeScript and Angular sources, by a scanner.

Comments, strings, templates and regular expressions are blanked first, with every offset kept, so that braces match and
patterns see code only. Declarations are then found by pattern, their bodies by matching brackets, and a call or access
belongs to the function whose span around it is shortest.
"""

from __future__ import annotations

import bisect
import posixpath
import re

from plexgraph.parsers.records import Entity, Parsed, file_entity, relative

_WORDS = frozenset("if for while switch catch return function typeof new await super import constructor do else in of case delete void throw yield async get set".split())
_NAME = r"[A-Za-z_$][\w$]*"
# Decorators and the labels that they make.
DECORATORS = {
    "Component": "AngularComponent",
    "Injectable": "AngularService",
    "Directive": "AngularDirective",
    "Pipe": "AngularPipe",
    "NgModule": "AngularModule",
    "Input": "AngularInput",
    "Output": "AngularOutput",
}
#: Characters kept of an entity's text, and of a component's inline template.
SNIPPET, TEMPLATE = 500, 200


_SPECIAL = re.compile(r"[/'\"`]")
_OPEN = re.compile(r"[({\[]")
_FIELD = re.compile(rf"\s*(?:(?:public|private|protected|static|readonly|declare|override|accessor)\s+)*#?({_NAME})\s*[?!]?\s*(?:[:=]|$)")
_NOT_BREAK = re.compile(r"[^\n]")
# Inside a literal, up to its end: escapes count as one character; a string or regular expression ends with its line.
_INSIDE = {
    "'": re.compile(r"(?:[^'\\\n]|\\(?s:.))*"), '"': re.compile(r'(?:[^"\\\n]|\\(?s:.))*'), "`": re.compile(r"(?:[^`\\]|\\(?s:.))*"),
    "/": re.compile(r"(?:[^/\\\n\[]|\\(?s:.)|\[(?:[^\]\\\n]|\\(?s:.))*\]?)*"),
}


def blanked(text: str) -> str:
    """text with comments and the insides of literals as spaces; line breaks and offsets stay."""
    out, i, n = [], 0, len(text)
    last = ""  # the last code character, which tells a division from a regular expression
    while m := _SPECIAL.search(text, i):
        at, c = m.start(), m[0]
        code = text[i:at]
        out.append(code)
        last = code.rstrip()[-1:] or last
        two = text[at : at + 2]
        if two in ("//", "/*"):
            end = text.find("\n" if two == "//" else "*/", at + 2)
            i = n if end < 0 else end if two == "//" else end + 2
            out.append(_NOT_BREAK.sub(" ", text[at:i]))
        elif c == "/" and last and last not in "(,=:[!&|?{};+-*%<>~^":
            out.append(c)
            last, i = c, at + 1
        else:
            end = _INSIDE[c].match(text, at + 1).end()
            out.append(c + _NOT_BREAK.sub(" ", text[at + 1 : end]) + text[end : end + 1])
            last, i = c, min(end + 1, n)
    out.append(text[i:])
    return "".join(out)


def _closing(code: str) -> dict[int, int]:
    """The offset of the bracket that closes each one, in one pass; the end of the text where there is none."""
    open_of, waiting = {")": "(", "}": "{", "]": "["}, {"(": [], "{": [], "[": []}
    out: dict[int, int] = {}
    for m in re.finditer(r"[(){}\[\]]", code):
        if m[0] in waiting:
            waiting[m[0]].append(m.start())
        elif waiting[open_of[m[0]]]:
            out[waiting[open_of[m[0]]].pop()] = m.start()
    return out | {at: len(code) - 1 for kind in waiting.values() for at in kind}


def _pieces(code: str) -> list[tuple[int, int]]:
    """Where the parts of a list stand that commas divide, outside of all brackets."""
    out, depth, at = [], 0, 0
    for m in re.finditer(r"[(){}\[\],]", code):
        depth += (m[0] in "({[") - (m[0] in ")}]")
        if m[0] == "," and not depth:
            out.append((at, m.start()))
            at = m.end()
    return [x for x in [*out, (at, len(code))] if code[x[0] : x[1]].strip()]


def parameters(args: str) -> dict:
    """What a parameter list, without its brackets, says of itself; counted by commas, as nothing else is known of it."""
    whole = args.strip()
    return {
        "parameters": f"({whole})", "parameter_count": whole.count(",") + 1 if whole else 0, "has_destructuring": "{" in whole or "[" in whole,
        "has_defaults": "=" in whole, "has_rest_params": "..." in whole, "has_type_annotations": ":" in whole,
    }


def assigned(statement: str, kind: str) -> dict:
    """What the text of a variable's declaration says of its value."""
    out: dict = {"declaration_type": kind}
    for word, name in (("=>", "is_arrow_function_assignment"), ("function", "is_function_assignment"), ("async", "is_async_assignment")):
        if word in statement:
            out[name] = True
            break
    out["has_destructuring"] = "{" in statement or "[" in statement
    if statement.count("{") > statement.count("=>"):
        out["is_object_literal"] = True
    if "[" in statement:
        out["has_array_syntax"] = True
    out["has_template_literal"], out["has_spread_operator"] = "`" in statement, "..." in statement
    modern = ("has_destructuring", "is_arrow_function_assignment", "has_template_literal", "has_spread_operator")
    return out | {"modern_js_complexity": sum(bool(out.get(k)) for k in modern)}


class _Scan:
    def __init__(self, path: str, text: str):
        self.text, self.code = text, blanked(text)
        self.closing = _closing(self.code)
        self.out = Parsed(path)
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.file = file_entity(self.out, text, text.count("\n") + 1)
        self.spans: list[tuple[int, int, Entity]] = []  # of functions, methods and constructors
        self.classes: list[tuple[int, int, Entity]] = []

    def line(self, at: int) -> int:
        return bisect.bisect_left(self.breaks, at) + 1

    def add(self, name: str, kind: str, start: int, end: int, **props) -> Entity:
        snippet = self.text[start : min(end + 1, start + SNIPPET)]
        e = self.out.entity(name, kind, self.line(start), self.line(end), posixpath.basename(self.out.path), file_id=self.file.id, code_snippet=snippet, **props)
        self.out.link(self.file.id, e.id, f"FILE_CONTAINS_{kind.upper()}")
        return e

    def around(self, at: int, spans: list[tuple[int, int, Entity]]) -> Entity | None:
        """The shortest span around an offset; the first of equals."""
        best = None
        for a, b, e in spans:
            if a <= at <= b and (best is None or b - a < best[0]):
                best = (b - a, e)
        return best[1] if best else None

    def body(self, at: int) -> tuple[int, int] | None:
        """The braces that open at or after `at`, before the statement ends."""
        k = at
        while k < len(self.code) and self.code[k] not in "{;":
            k = self.closing[k] if self.code[k] in "([" else k
            k += 1
        return (k, self.closing[k]) if k < len(self.code) and self.code[k] == "{" else None

    def imports(self) -> None:
        for m in re.finditer(r"\bimport\b([^;'\"]*?)(?:\bfrom\s*)?(['\"])", self.code):
            end = self.text.find(m[2], m.end())
            if end < 0:
                continue
            target, names = self.text[m.end() : end], m[1]
            local = target.startswith(".")
            default = re.match(rf"\s*(?:type\s+)?({_NAME})", names)
            e = self.add(target, "Import", m.start(), end, module_name=target, is_relative=local, is_default=bool(default), is_namespace="*" in names, line_number=self.line(m.start()), is_from_import=True)
            goal = f"?file:{relative(self.out.path, target)}" if local else f"?module:{target}"
            # From the file, and from the import itself: queries follow either.
            for end in (self.file.id, e.id):
                self.out.link(end, goal, "IMPORTS", import_type="es")
            braces = re.search(r"\{([^}]*)\}", names)
            for part in braces[1].split(",") if braces else ():
                word = re.match(rf"\s*(?:type\s+)?({_NAME})", part)
                if word:
                    self.out.link(self.file.id, f"?name:{word[1]}", "USES", usage_type="import", line_number=e.line_start)

    def exports(self) -> None:
        for m in re.finditer(rf"\bexport\s+(default\s+)?(?:(?:abstract\s+|async\s+|declare\s+)*(?:class|function\*?|const|let|var|interface|type|enum)\s+)?({_NAME}|\{{[^}}]*\}})", self.code):
            default = bool(m[1])
            names = [p.split(" as ")[0].strip() for p in m[2].strip("{}").split(",")] if m[2].startswith("{") else [m[2]]
            for name in filter(None, names):
                e = self.add(name, "Export", m.start(), m.end(), export_type="default" if default else "named", is_default=default, line_number=self.line(m.start()))
                self.out.link(self.file.id, e.id, "EXPORTS", export_type="default" if default else "named", symbol=name)

    def types(self) -> None:
        for m in re.finditer(rf"\b(class|interface|enum)\s+({_NAME})([^{{;]*)\{{", self.code):
            start, end = m.end() - 1, self.closing[m.end() - 1]
            inside = self.code[start + 1 : end]
            if m[1] == "interface":
                methods = len(re.findall(rf"\b{_NAME}\s*\??\s*\([^)]*\)\s*:", inside))
                self.add(m[2], "Interface", m.start(), end, method_count=methods, property_count=len(re.findall(rf"\b{_NAME}\s*\??\s*:", re.sub(r"\([^)]*\)\s*:[^;\n]*", "", inside))))
            elif m[1] == "enum":
                self.add(m[2], "Enum", m.start(), end, values=[v.split("=")[0].strip() for v in inside.split(",") if v.strip()])
            else:
                c = self.add(m[2], "Class", m.start(), end, is_abstract=bool(re.search(r"\babstract\s+$", self.code[: m.start()][-20:])))
                self.classes.append((m.start(), end, c))
                c.props |= {"method_count": "0", "property_count": str(self.fields(start, end))}
                base = re.search(rf"\bextends\s+({_NAME}(?:\.{_NAME})*)", m[3])
                if base:
                    c.props["extends"] = base[1]
                    self.out.link(c.id, f"?class:{base[1]}", "EXTENDS")
                    self.out.link(c.id, f"?class:{base[1]}", "INHERITS")
                held = re.search(r"\bimplements\s+([^{]*)", m[3])
                for name in held[1].split(",") if held else ():
                    self.out.link(c.id, f"?interface:{name.split('<')[0].strip()}", "IMPLEMENTS")
                self.members(c, start, end)
        for m in re.finditer(rf"\btype\s+({_NAME})(?:<[^>]*>)?\s*=\s*([^;\n]*)", self.code):
            self.add(m[1], "Type", m.start(), m.end(), type_definition=m[2].strip()[:200])

    def fields(self, start: int, end: int) -> int:
        """Fields of a class body: its statements, without what stands in brackets, that begin with a name and are no
        member with parameters."""
        parts, at = [], start + 1
        while m := _OPEN.search(self.code, at, end):
            parts.append(self.code[at : m.end()])
            at = self.closing[m.start()]
        flat = "".join(parts) + self.code[at:end]
        # A block ends a statement, unless it is a value.
        heads = re.split(r"[;\n]|(?<==>)\s*\{\}|\{\}", re.sub(rf"@{_NAME}(?:\.{_NAME})*(?:\(\))?", " ", flat))
        return sum(bool((m := _FIELD.match(x)) and m[1] not in _WORDS) for x in heads)

    def members(self, holder: Entity, start: int, end: int) -> None:
        head = re.compile(rf"((?:\b(?:public|private|protected|static|async|readonly|override|abstract|get|set)\s+)*)(\*?)\s*(#?{_NAME})\s*(?:<[^>(]*>)?\(")
        at = start + 1
        while at < end:
            if self.code[at] in "{([":
                at = self.closing[at] + 1
                continue
            m = head.match(self.code, at)
            # A member starts after a break in the class body, never in the middle of an expression.
            if not m or m[3] in _WORDS - {"constructor", "get", "set", "delete", "import"} or self.code[start:at].rstrip()[-1:] not in "{};)" and "\n" not in self.code[at - 1 : at + 1] and not self.code[at - 1].isspace():
                at += 1
                continue
            close = self.closing[m.end() - 1]
            body = self.body(close + 1)
            between = self.code[close + 1 : body[0]] if body else ""
            if not body or body[1] > end or re.search(r"[=;]", between.split("=>")[0]) or self.code[start:at].rstrip()[-1:] in (".", "=", ",", "(", "?"):
                at = m.end() - 1
                continue
            words = m[1].split()
            kind = "Constructor" if m[3] == "constructor" else "Getter" if "get" in words else "Setter" if "set" in words else "Method"
            shared = {"class_id": holder.id, "accessibility": next((w for w in words if w in ("public", "private", "protected")), "public")}
            args = self.text[m.end() : close].strip()
            returns = between.strip().lstrip(":").strip()
            own = {
                "Method": {"signature": f"{m[3]}({args})", "return_type": returns, "is_async": "async" in words, "is_static": "static" in words},
                "Constructor": {"signature": f"constructor({args})"},
                "Getter": {"return_type": returns},
                "Setter": {"parameter_type": args.partition(":")[2].strip()},
            }[kind]
            begin = m.start(1) if m[1] else m.start(3)
            e = self.add(m[3], kind, begin, body[1], **shared, **own, **parameters(args), method_kind=kind.lower())
            holder.props["method_count"] = str(int(holder.props["method_count"]) + 1)
            self.out.link(holder.id, e.id, f"CLASS_CONTAINS_{kind.upper()}")
            self.spans.append((begin, body[1], e))
            at = body[1] + 1

    def functions(self) -> None:
        for m in re.finditer(rf"\b(async\s+)?function\s*(\*?)\s*({_NAME})?\s*(?:<[^>(]*>)?\(", self.code):
            close = self.closing[m.end() - 1]
            body = self.body(close + 1)
            if not body:
                continue
            name = m[3] or f"anonymous_L{self.line(m.start())}"
            args = self.text[m.end() : close].strip()
            kind = "GeneratorFunction" if m[2] else "Function"
            extra = {} if m[2] else {"is_generator": False, "complexity": self.complexity(*body)}
            extra |= parameters(args) | {"is_arrow": False, "function_style": "generator" if m[2] else "async" if m[1] else "traditional"}
            e = self.add(name, kind, m.start(), body[1], signature=f"{name}({args})", return_type=self.code[close + 1 : body[0]].strip().lstrip(":").strip(), is_async=bool(m[1]), **extra)
            self.spans.append((m.start(), body[1], e))
        for m in re.finditer(rf"(?:\b(?:const|let|var)\s+({_NAME})[^=;\n]*=\s*)?(\basync\s*)?(?:\(([^()]*(?:\([^()]*\)[^()]*)*)\)|\b({_NAME}))\s*(?::\s*[\w<>\[\]| ]+)?\s*=>", self.code):
            k = m.end()
            while k < len(self.code) and self.code[k].isspace():
                k += 1
            if k < len(self.code) and self.code[k] in "{(":
                end = self.closing[k]
            else:
                end = min(x if x >= 0 else len(self.code) - 1 for x in (self.code.find(";", k), self.code.find("\n", k)))
            start = m.start(1) if m[1] else m.start()
            name = m[1] or f"arrow_function_L{self.line(start)}_{self.line(end)}"
            args = self.text[m.start(3) : m.end(3)].strip() if m[3] is not None else (m[4] or "").strip()
            e = self.add(name, "ArrowFunction", start, end, signature=f"{name}({args})", is_async=bool(m[2]), is_arrow=True, function_style="arrow", **parameters(args))
            self.spans.append((start, end, e))

    def complexity(self, a: int, b: int) -> int:
        return 1 + len(re.findall(r"\b(?:if|for|while|catch|case)\b|&&|\|\||\?(?![.?:])", self.code[a:b]))

    def statement_end(self, at: int) -> int:
        """Where a statement ends: a semicolon or a line break outside of brackets."""
        while m := re.compile(r"[({\[;\n)}\]]").search(self.code, at):
            if m[0] not in "({[":
                return m.start()
            at = self.closing[m.start()] + 1
        return len(self.code)

    def variables(self) -> None:
        for m in re.finditer(rf"\b(const|let|var)\s+({_NAME}|\[[^\]]*\]|\{{[^}}]*\}})[^=;\n]*=(?!=|>)", self.code):
            kind = "ArrayPattern" if m[2].startswith("[") else "Variable"
            holder = self.around(m.start(), self.spans)
            end = self.statement_end(m.end())
            more = {"pattern_type": "array"} if kind == "ArrayPattern" else {"line_number": self.line(m.start()), "is_global": holder is None, "is_constant": m[1] == "const", "scope_id": holder.id if holder else self.file.id}
            # Literals count by their marks, which stand in the code; what they hold is blank there.
            self.add(m[2][:50], kind, m.start(), m.end(), **more, **assigned(self.code[m.start() : end], m[1]))

    def calls(self) -> None:
        for m in re.finditer(rf"({_NAME}(?:\??\.{_NAME})*)\s*\(", self.code):
            holder, name = self.around(m.start(), self.spans), m[1].replace("?.", ".")
            last = name.rsplit(".", 1)[-1]
            if holder is None or name in _WORDS or last == holder.name and holder.line_start == self.line(m.start()) and "." not in name:
                continue
            if name.startswith("this.") and name.count(".") == 1:
                own = self.around(m.start(), self.classes)
                name = f"{own.name}.{last}" if own else last
            self.out.link(holder.id, f"?function:{name}", "CALLS", call_type="function_call", line_number=self.line(m.start()))
        for m in re.finditer(rf"({_NAME}(?:\??\.{_NAME})+)(?!\s*\(|[\w$])", self.code):
            holder = self.around(m.start(), self.spans)
            if holder is not None:
                self.out.link(holder.id, f"?variable:{m[1].replace('?.', '.')}", "ACCESSES", property_path=m[1], access_location=self.line(m.start()))

    def config(self, start: int, end: int) -> dict[str, str]:
        """The object literal of a decorator's arguments: the text of each value by its key."""
        at = self.code.find("{", start, end)
        if at < 0:
            return {}
        out, inside = {}, at + 1
        code = self.code[inside : self.closing[at]]
        for a, b in _pieces(code):
            colon = code.find(":", a, b)
            if colon >= 0:
                key = self.text[inside + a : inside + colon].strip().strip("'\"")
                # Comments before a key are blank in the code, but not in the text.
                key = key if re.fullmatch(r"[\w$-]+", key) else code[a:colon].strip()
                out[key] = self.text[inside + colon + 1 : inside + b].strip()
        return out

    def decorators(self) -> None:
        for m in re.finditer(rf"@({_NAME})\s*\(", self.code):
            close = self.closing[m.end() - 1]
            label = DECORATORS.get(m[1])
            arguments = self.text[m.end() : close]
            if label is None:
                self.add(m[1], "Decorator", m.start(), close, decorator_name=m[1], arguments=arguments[:200])
                continue
            given = self.config(m.end(), close)
            member = label in ("AngularInput", "AngularOutput")
            follows = re.compile(rf"\b(?:readonly\s+|set\s+)?({_NAME})" if member else rf"\bclass\s+({_NAME})").search(self.code, close + 1)
            holder = follows[1] if follows else m[1]

            def string(key: str, given: dict[str, str] = given) -> str | None:
                value = given.get(key, "")
                return value[1:-1] if value[:1] in ("'", '"', "`") and value[-1:] == value[:1] else None

            def listed(key: str, given: dict[str, str] = given) -> list[str] | None:
                value = given.get(key, "")
                return [x.strip().strip("'\"`") for x in value[1:-1].split(",") if x.strip()] if value[:1] == "[" else None

            alone = {"true": True, "false": False}.get(given.get("standalone", ""))
            template, styles = string("template"), [s for s in [string("styleUrl"), *(listed("styleUrls") or [])] if s]
            own = {
                "AngularComponent": lambda: {
                    "selector": string("selector"), "template_url": string("templateUrl"), "style_url": ",".join(styles) or None, "standalone": alone, "imports": listed("imports"),
                    "template": template[:TEMPLATE] if template is not None else None, "has_inline_styles": "styles" in given, "class_name": holder,
                },
                "AngularService": lambda: {"provided_in": string("providedIn")},
                "AngularDirective": lambda: {"selector": string("selector"), "standalone": alone},
                "AngularPipe": lambda: {"pipe_name": string("name"), "standalone": alone},
                "AngularModule": lambda: {k: listed(k) for k in ("declarations", "imports", "exports", "providers")} | {f"has_{k}": k in given for k in ("declarations", "imports", "exports", "providers")},
                "AngularInput": lambda: {"input_name": string("alias") or ("" if given else arguments.strip().strip("'\"")) or holder, "required": given.get("required") == "true"},
                "AngularOutput": lambda: {"output_name": arguments.strip().strip("'\"") or holder},
            }[label]()
            # A component is known by its selector, anything else by what is decorated.
            e = self.add(own.get("selector") or holder if label == "AngularComponent" else holder, label, m.start(), close, **own)
            if label == "AngularComponent":
                for target, kind, end, prop in [(own["template_url"], "USES_TEMPLATE", "template", "template_path"), *((s, "USES_STYLES", "style", "style_path") for s in styles)]:
                    if target:
                        self.out.link(e.id, f"?{end}:{target}", kind, **{prop: target}, resolved_path=relative(self.out.path, target), component_selector=own["selector"])


def parse(path: str, text: str) -> Parsed:
    s = _Scan(path, text)
    s.imports()
    s.exports()
    s.types()
    s.functions()
    s.variables()
    s.decorators()
    s.calls()
    return s.out
