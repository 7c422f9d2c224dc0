"""A read-only Cypher front end: text to syntax tree to DataFrame.

Covered: MATCH and OPTIONAL MATCH with node and relationship patterns, inline properties, both directions and none,
variable length, path variables; WHERE with comparisons, logic, string predicates, IN, IS NULL, exists(), pattern
predicates and count{}; WITH; RETURN [DISTINCT] with aliases and aggregates; ORDER BY; SKIP; LIMIT; parameters; CALL
show_tables() and schema.info(). Each bound variable is a set of columns `var.property`; Catalyst prunes what is not
asked for. Patterns become joins, pattern predicates semi and anti joins, variable length loops in operators.patterns.

Bounds of `*`: with both bounds, walks (of a cyclic pattern one row for each start and length); without an upper one,
reachability at the least depth, or every path that repeats no node where the path itself is asked for. A cyclic
pattern (a)-[*]->(a) without an upper bound gives each start once, at the least length from the lower bound on, or, where
the path or relationship has a name, every cycle that repeats no node but its start. No length is cut; the number of
paths can grow exponentially.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexgraph.operators import patterns as P
from plexgraph.plans.catalog import GraphCatalog
from plexgraph.storage import stash

class CypherError(ValueError):
    """Text that is not in the supported language."""


_TOKEN = re.compile(
    r"""\s*(?:(?P<string>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<number>\d+(?:\.\d+)?(?!\.\d))|(?P<param>\$\w+)|(?P<name>`[^`]+`|[A-Za-z_]\w*)
    |(?P<op><>|<=|>=|=~|\.\.|[-+*/%=<>(){}\[\],.:|;]))""",
    re.X,
)
_WRITES = frozenset("CREATE DELETE DETACH SET REMOVE MERGE DROP ALTER COPY INSTALL LOAD".split())
_AGGREGATES = frozenset("count collect min max sum avg".split())


@dataclass
class Token:
    kind: str
    text: str
    at: int
    end: int


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    text = re.sub(r"//[^\n]*", lambda m: " " * len(m[0]), text)
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise CypherError(f"unexpected character at {at}: {text[at : at + 10]!r}")
        out.append(Token(m.lastgroup, m[m.lastgroup], m.start(m.lastgroup), m.end()))
        at = m.end()
    return out


@dataclass
class Node:
    var: str
    label: str | None
    props: dict


@dataclass
class Rel:
    var: str
    types: list[str]
    direction: str  # out, in or both
    least: int = 1
    most: int | None = 1
    variable: bool = False


@dataclass
class Pattern:
    path: str | None
    nodes: list[Node]
    rels: list[Rel]


@dataclass
class Item:
    expr: tuple
    name: str


@dataclass
class Clause:
    kind: str  # match, optional, with, return, call
    patterns: list[Pattern] = field(default_factory=list)
    where: tuple | None = None
    items: list[Item] = field(default_factory=list)
    distinct: bool = False
    order: list[tuple] = field(default_factory=list)
    skip: tuple | None = None
    limit: tuple | None = None


class Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.at, self.count = text, tokens(text), 0, 0
        for t in self.tokens:
            if t.kind == "name" and t.text.upper() in _WRITES:
                raise CypherError(f"{t.text} is not allowed: queries are read-only")

    def peek(self, *words: str, ahead: int = 0) -> bool:
        k = self.at + ahead
        return k < len(self.tokens) and self.tokens[k].kind != "string" and self.tokens[k].text.upper() in words

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.at += 1
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            got = self.tokens[self.at].text if self.at < len(self.tokens) else "the end"
            raise CypherError(f"expected {word}, got {got}")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at].kind != "name":
            raise CypherError("expected a name")
        self.at += 1
        return self.tokens[self.at - 1].text.strip("`")

    def fresh(self) -> str:
        self.count += 1
        return f"_{self.count}"

    def query(self) -> list[Clause]:
        out = []
        while self.at < len(self.tokens) and not self.take(";"):
            if self.take("OPTIONAL"):
                self.need("MATCH")
                out.append(self.match("optional"))
            elif self.take("MATCH"):
                out.append(self.match("match"))
            elif self.take("WITH"):
                out.append(self.projection("with"))
            elif self.take("RETURN"):
                out.append(self.projection("return"))
            elif self.take("CALL"):
                called = self.name()
                while self.take("."):
                    called += "." + self.name()
                c = Clause("call", items=[Item(("name", called), "")])
                while self.at < len(self.tokens) and not self.peek("RETURN"):
                    self.at += 1
                self.need("RETURN")
                self.need("*")
                out.append(c)
            else:
                raise CypherError(f"unexpected {self.tokens[self.at].text}")
        if not out or out[-1].kind not in ("return", "call"):
            raise CypherError("a query ends with RETURN")
        return out

    def match(self, kind: str) -> Clause:
        c = Clause(kind, [self.pattern()])
        while self.take(","):
            c.patterns.append(self.pattern())
        if self.take("WHERE"):
            c.where = self.expr()
        return c

    def projection(self, kind: str) -> Clause:
        c = Clause(kind, distinct=self.take("DISTINCT"))
        while True:
            start = self.tokens[self.at].at if self.at < len(self.tokens) else 0
            e = self.expr()
            end = self.tokens[self.at - 1].end
            c.items.append(Item(e, self.name() if self.take("AS") else re.sub(r"\s+", " ", self.text[start:end].strip())))
            if not self.take(","):
                break
        if kind == "with" and self.take("WHERE"):
            c.where = self.expr()
        if self.take("ORDER"):
            self.need("BY")
            while True:
                e = self.expr()
                c.order.append((e, not self.take("DESC", "DESCENDING")))
                self.take("ASC", "ASCENDING")
                if not self.take(","):
                    break
        if self.take("SKIP"):
            c.skip = self.primary()
        if self.take("LIMIT"):
            c.limit = self.primary()
        if kind == "with" and self.take("WHERE"):
            c.where = self.expr()
        return c

    def pattern(self) -> Pattern:
        path = None
        if self.peek("=", ahead=1):
            path = self.name()
            self.need("=")
        nodes, rels = [self.node()], []
        while self.peek("-", "<"):
            rels.append(self.rel())
            nodes.append(self.node())
        return Pattern(path, nodes, rels)

    def node(self) -> Node:
        self.need("(")
        var = self.name() if self.at < len(self.tokens) and self.tokens[self.at].kind == "name" else self.fresh()
        label = self.name() if self.take(":") else None
        props = self.props()
        self.need(")")
        return Node(var, label, props)

    def props(self) -> dict:
        out = {}
        if self.take("{"):
            while not self.take("}"):
                key = self.name()
                self.need(":")
                out[key] = self.expr()
                self.take(",")
        return out

    def rel(self) -> Rel:
        left = self.take("<")
        self.need("-")
        r = Rel(self.fresh(), [], "both")
        if self.take("["):
            if self.tokens[self.at].kind == "name":
                r.var = self.name()
            if self.take(":"):
                r.types.append(self.name())
                while self.take("|"):
                    self.take(":")
                    r.types.append(self.name())
            if self.take("*"):
                r.variable, r.least, r.most = True, 1, None
                number = lambda: int(self.tokens[self.at - 1].text)
                if self.tokens[self.at].kind == "number":
                    self.at += 1
                    r.least = r.most = number()
                if self.take(".."):
                    r.most = None
                    if self.tokens[self.at].kind == "number":
                        self.at += 1
                        r.most = number()
            self.need("]")
        self.need("-")
        right = self.take(">")
        r.direction = "in" if left and not right else "out" if right and not left else "both"
        return r

    # Expressions, loosest first.
    def expr(self) -> tuple:
        left = self.and_()
        while self.take("OR"):
            left = ("or", left, self.and_())
        return left

    def and_(self) -> tuple:
        left = self.not_()
        while self.take("AND"):
            left = ("and", left, self.not_())
        return left

    def not_(self) -> tuple:
        return ("not", self.not_()) if self.take("NOT") else self.comparison()

    def comparison(self) -> tuple:
        left = self.sum()
        if self.take("IS"):
            negated = self.take("NOT")
            self.need("NULL")
            return ("not", ("null", left)) if negated else ("null", left)
        if self.take("STARTS"):
            self.need("WITH")
            return ("starts", left, self.sum())
        if self.take("ENDS"):
            self.need("WITH")
            return ("ends", left, self.sum())
        if self.take("CONTAINS"):
            return ("contains", left, self.sum())
        if self.take("IN"):
            return ("in", left, self.sum())
        for op in ("<>", "<=", ">=", "=", "<", ">"):
            if self.take(op):
                return (op, left, self.sum())
        if self.peek("=~"):
            raise CypherError("regular expressions are not supported")
        return left

    def sum(self) -> tuple:
        left = self.product()
        while self.peek("+", "-"):
            op = "+" if self.take("+") else "-" if self.take("-") else ""
            left = (op, left, self.product())
        return left

    def product(self) -> tuple:
        left = self.primary()
        while self.peek("*", "/", "%"):
            op = self.tokens[self.at].text
            self.at += 1
            left = (op, left, self.primary())
        return left

    def is_pattern(self) -> bool:
        """Whether a node pattern that starts here is followed by a relationship."""
        depth, k = 0, self.at
        while k < len(self.tokens):
            depth += {"(": 1, ")": -1}.get(self.tokens[k].text, 0)
            k += 1
            if not depth:
                break
        inside = self.tokens[self.at + 1 : k - 1]
        plain = not inside or inside[0].kind == "name" and (len(inside) == 1 or inside[1].text in ":{") or inside[0].text in ":{"
        return plain and k + 1 < len(self.tokens) and (self.tokens[k].text == "-" and self.tokens[k + 1].text in "-[" or self.tokens[k].text == "<" and self.tokens[k + 1].text == "-")

    def primary(self) -> tuple:
        if self.at >= len(self.tokens):
            raise CypherError("unexpected end")
        if self.peek("("):
            if self.is_pattern():
                return ("pattern", self.pattern())
            self.need("(")
            e = self.expr()
            self.need(")")
            return self.postfix(e)
        t = self.tokens[self.at]
        self.at += 1
        if t.kind == "string":
            return ("lit", re.sub(r"\\(.)", r"\1", t.text[1:-1]))
        if t.kind == "number":
            return ("lit", float(t.text) if "." in t.text else int(t.text))
        if t.kind == "param":
            return ("param", t.text[1:])
        if t.text == "[":
            items = []
            while not self.take("]"):
                items.append(self.expr())
                self.take(",")
            return ("list", items)
        if t.text == "-":
            return ("-", ("lit", 0), self.primary())
        if t.text == "*":
            return ("star",)
        if t.kind != "name":
            raise CypherError(f"unexpected {t.text}")
        word = t.text.lower()
        if word in ("true", "false", "null"):
            return ("lit", {"true": True, "false": False, "null": None}[word])
        if word == "count" and self.take("{"):
            self.take("MATCH")
            p = self.pattern()
            self.need("}")
            return ("countof", p)
        if self.take("("):
            if word == "exists" and (self.peek("(") and self.is_pattern()):
                p = self.pattern()
                self.need(")")
                return ("pattern", p)
            distinct, args = self.take("DISTINCT"), []
            while not self.take(")"):
                args.append(self.expr())
                self.take(",")
            return self.postfix(("call", word, args, distinct))
        return self.postfix(("name", t.text.strip("`")))

    def postfix(self, e: tuple) -> tuple:
        while True:
            if self.take("."):
                e = ("prop", e, self.name())
            elif self.take("["):
                e = ("index", e, self.expr())
                self.need("]")
            else:
                return e


def variables(e) -> set[str]:
    """Variables that an expression names."""
    if isinstance(e, Pattern):
        return {n.var for n in e.nodes if not n.var.startswith("_")}
    if isinstance(e, tuple):
        return {e[1]} if e[0] == "name" else set().union(*(variables(x) for x in e[1:])) if len(e) > 1 else set()
    return set().union(*(variables(x) for x in e)) if isinstance(e, list) and e else set()


def _aggregates(e) -> bool:
    if isinstance(e, tuple) and e and e[0] == "call" and e[1] in _AGGREGATES:
        return True
    return any(_aggregates(x) for x in e) if isinstance(e, (tuple, list)) else False


def _counts(e) -> bool:
    """Whether an aggregate in e depends on how often a row stands."""
    if isinstance(e, tuple) and e and e[0] == "call" and e[1] in _AGGREGATES:
        return e[1] in ("sum", "avg") or e[1] in ("count", "collect") and not e[3]
    return any(_counts(x) for x in e) if isinstance(e, (tuple, list)) else False


def _valued(e) -> set[str]:
    """The variables in e outside length(..) and count(..)."""
    if isinstance(e, tuple) and len(e) == 2 and e[0] == "name":
        return {e[1]}
    if isinstance(e, tuple) and e and e[0] == "call" and e[1] in ("length", "count"):
        return set().union(*(_valued(x) for x in e[2] if x[0] != "name"))
    return set().union(*map(_valued, e)) if isinstance(e, (tuple, list)) else set()


def _conjuncts(e: tuple | None) -> list[tuple]:
    return [] if e is None else [*_conjuncts(e[1]), *_conjuncts(e[2])] if e[0] == "and" else [e]


class Planner:
    def __init__(self, catalog: GraphCatalog, params: dict, properties: tuple[str, ...] = ()):
        self.g, self.params, self.properties = catalog, params, properties  # properties: all that the text names
        self.rows: DataFrame | None = None
        self.labels: dict[str, str | None] = {}  # of bound nodes
        self.edges: dict[str, str | None] = {}  # of bound relationships: their type
        self.paths: set[str] = set()
        self.scalars: set[str] = set()
        self.pending: list[tuple] = []
        self.path_values = False
        self.valued: set[str] = set()  # variables of which the text asks for more than a length or a number
        self.joining: set[str] = set()  # columns of rows that are about to be joined
        self.once = False  # the next result does not depend on how often a row stands

    # Columns of a variable are `var.property`.
    def col(self, var: str, prop: str) -> Column:
        return F.col(f"`{var}.{prop}`")

    def bound(self) -> set[str]:
        return {*self.labels, *self.edges, *self.paths, *self.scalars}

    def scan(self, node: Node) -> DataFrame:
        if node.label:
            rows = self.g.node(node.label)
            rows = rows.withColumns({"__label": F.lit(node.label), "__gid": F.concat_ws(":", F.lit(node.label), F.col("id").cast("string"))})
        else:
            rows = self.g.any_node(properties=self.properties)
            more = [c for c in rows.columns if c not in ("label", "gid", "name")]
            rows = rows.select(F.col("gid").alias("id"), "name", *more, F.col("label").alias("__label"), F.col("gid").alias("__gid"))
        for key, value in node.props.items():
            rows = rows.filter(F.col(key) == self.value(value))
        return rows.select(*[F.col(f"`{c}`").alias(f"{node.var}.{c}") for c in rows.columns])

    def settle(self) -> None:
        """Apply every pending condition whose variables are bound."""
        rest = []
        for c in self.pending:
            if variables(c) <= self.bound():
                self.filter(c)
            else:
                rest.append(c)
        self.pending = rest

    def filter(self, e: tuple) -> None:
        negated = e[0] == "not" and e[1][0] == "pattern"
        if negated or e[0] == "pattern":
            self.exists(e[1][1] if negated else e[1], negated)
        else:
            self.count_columns(e)
            self.rows = self.rows.filter(self.value(e))

    def exists(self, p: Pattern, negated: bool) -> None:
        """A pattern of one hop with one bound end, or both, as a semi or anti join."""
        if len(p.rels) != 1 or p.rels[0].variable:
            raise CypherError("a pattern predicate has one hop")
        a, r, b = p.nodes[0], p.rels[0], p.nodes[1]
        edges = self.rel_rows(r, a.label or self.labels.get(a.var), b.label or self.labels.get(b.var))
        on = []
        for node, end in ((a, "__src"), (b, "__dst")):
            if node.var in self.labels:
                on.append(self.col(node.var, "__gid") == F.col(end))
            elif node.label or node.props:
                kept = self.scan(node).select(F.col(f"`{node.var}.__gid`").alias(end))
                edges = edges.join(kept, end, "left_semi")
        if not on:
            raise CypherError("a pattern predicate needs a bound node")
        cond = on[0] if len(on) == 1 else on[0] & on[1]
        self.rows = self.rows.join(edges.select("__src", "__dst"), cond, "left_anti" if negated else "left_semi")

    def rel_rows(self, r: Rel, source: str | None, target: str | None) -> DataFrame:
        """Edges (__src, __dst as label:id, __type, properties) in the pattern's direction."""
        found = [v for t in (r.types or [None]) for v in self.g.variants(t)]
        if r.direction != "both":
            s, t = (source, target) if r.direction == "out" else (target, source)
            found = [v for v in found if (not s or v.source == s) and (not t or v.target == t)] or found
        parts = []
        for v in found:
            e = v.rows()
            more = [c for c in e.columns if c not in ("src", "dst")]
            parts.append(e.select(F.concat_ws(":", F.lit(v.source), F.col("src").cast("string")).alias("__src"), F.concat_ws(":", F.lit(v.target), F.col("dst").cast("string")).alias("__dst"), F.lit(v.name).alias("__type"), *more))
        edges = parts[0]
        for p in parts[1:]:
            edges = edges.unionByName(p, allowMissingColumns=True)
        turned = edges.withColumnsRenamed({"__src": "__x", "__dst": "__src"}).withColumnRenamed("__x", "__dst")
        return edges if r.direction == "out" else turned if r.direction == "in" else edges.unionByName(turned.select(edges.columns))

    def bind(self, node: Node) -> None:
        """Bring in a node that is not bound: alone, or as a further part of the pattern (a product that conditions
        turn into a join)."""
        if node.var in self.labels:
            if node.props:
                for key, value in node.props.items():
                    self.rows = self.rows.filter(self.col(node.var, key) == self.value(value))
            return
        rows = self.scan(node)
        self.rows = rows if self.rows is None else self.join_product(rows, node)
        self.labels[node.var] = node.label
        self.settle()

    def join_product(self, rows: DataFrame, node: Node) -> DataFrame:
        """Another part of the pattern: joined on the equalities that name both sides; never a bare product."""
        on, self.joining = [], set(rows.columns)
        for c in list(self.pending):
            if c[0] == "=" and variables(c) <= self.bound() | {node.var} and node.var in variables(c):
                self.labels[node.var] = node.label
                on.append(self.value(c))
                del self.labels[node.var]
                self.pending.remove(c)
        self.joining = set()
        if not on:
            raise CypherError("parts of a pattern must be joined by an equality")
        cond = on[0]
        for c in on[1:]:
            cond = cond & c
        return self.rows.join(rows, cond)

    def pattern(self, p: Pattern, optional: bool = False) -> None:
        if not p.rels:
            self.bind(p.nodes[0])
            return
        # Start from a bound node, else from one that is narrowed by properties or a condition.
        def rank(n: Node) -> int:
            own = any(variables(c) == {n.var} for c in self.pending)
            return 0 if n.var in self.labels else 1 if n.props else 2 if own else 3

        start = min(range(len(p.nodes)), key=lambda i: (rank(p.nodes[i]), i))
        if optional and rank(p.nodes[start]):
            raise CypherError("OPTIONAL MATCH starts from a bound node")
        self.bind(p.nodes[start])
        for i in range(start, len(p.rels)):
            self.hop(p.nodes[i], p.rels[i], p.nodes[i + 1], False, p.path)
        for i in range(start - 1, -1, -1):
            self.hop(p.nodes[i + 1], p.rels[i], p.nodes[i], True, p.path)

    def hop(self, at: Node, r: Rel, to: Node, back: bool, path: str | None) -> None:
        """Follow a relationship from a bound node; back: against the order in which the pattern is written."""
        source, target = (to, at) if back else (at, to)
        edges = self.rel_rows(r, source.label or self.labels.get(source.var), target.label or self.labels.get(target.var))
        if back:
            edges = edges.withColumnsRenamed({"__src": "__x", "__dst": "__src"}).withColumnRenamed("__x", "__dst")
        if r.variable:
            self.variable(at, r, to, edges, back, path)
            return
        more = [c for c in edges.columns if c not in ("__src", "__dst")]
        e = edges.select(F.col("__src").alias("__at"), F.col("__dst").alias("__to"), *[F.col(c).alias(f"{r.var}.{c}") for c in more])
        self.rows = self.rows.join(e, self.col(at.var, "__gid") == F.col("__at")).drop("__at")
        self.edges[r.var] = None
        self.arrive(to)

    def arrive(self, to: Node) -> None:
        if to.var in self.labels:
            self.rows = self.rows.filter(F.col("__to") == self.col(to.var, "__gid")).drop("__to")
        else:
            self.rows = self.rows.join(self.scan(to), F.col("__to") == F.col(f"`{to.var}.__gid`")).drop("__to")
            self.labels[to.var] = to.label
        self.settle()

    def variable(self, at: Node, r: Rel, to: Node, edges: DataFrame, back: bool, path: str | None) -> None:
        e = stash(edges.select(F.col("__src").alias("src"), F.col("__dst").alias("dst")), "hops")
        seeds = stash(self.rows.select(self.col(at.var, "__gid").alias("start")).distinct(), "starts")
        cyclic = at.var == to.var
        name = path or r.var
        # The lengths of a cycle without an upper bound can be told apart only by finding each.
        each = cyclic and r.most is None and (path or not r.var.startswith("_"))
        if each and name not in self.valued:
            found = P.circuits(seeds, e, r.least, values=False).withColumn("path", F.lit(None).cast("string"))
        elif path and self.path_values or each:
            found = P.paths(seeds, e, r.least, r.most, close=cyclic)
            nodes = F.reverse("path") if back else F.col("path")
            found = found.select("start", "node", "depth", F.array_join(nodes, " -> ").alias("path"))
        elif r.most is not None:
            found = P.walks(seeds, e, r.least, r.most, distinct=True) if cyclic or self.once else P.all_walks(seeds, e, r.least, r.most)
            found = found.withColumn("path", F.lit(None).cast("string"))
        elif cyclic:
            found = P.closures(seeds, e, r.least).withColumn("path", F.lit(None).cast("string"))
        else:
            found = P.reach_pairs(seeds, e).filter(F.col("depth") >= r.least).withColumn("path", F.lit(None).cast("string"))
        f = found.select(F.col("start").alias("__at"), F.col("node").alias("__to"), F.col("depth").alias(f"{name}.length"), F.col("path").alias(f"{name}.path"))
        self.rows = self.rows.join(f, self.col(at.var, "__gid") == F.col("__at")).drop("__at")
        self.paths.add(name)
        self.arrive(to)

    def match(self, c: Clause) -> None:
        if c.kind == "match":
            self.pending += _conjuncts(c.where)
            for p in c.patterns:
                self.pattern(p)
            if self.pending:
                raise CypherError(f"unknown variables in WHERE: {set().union(*map(variables, self.pending)) - self.bound()}")
            return
        # OPTIONAL MATCH: the inner match from the bound node's keys, joined back from the left.
        for p in c.patterns:
            keys = [n.var for n in p.nodes if n.var in self.labels]
            if not keys:
                raise CypherError("OPTIONAL MATCH starts from a bound node")
            inner = Planner(self.g, self.params)
            inner.path_values, inner.valued, inner.once = self.path_values, self.valued, self.once
            inner.labels = {k: self.labels[k] for k in keys}
            own = [x for x in self.rows.columns if x.split(".")[0] in keys]
            inner.rows = self.rows.select(*[F.col(f"`{x}`") for x in own]).distinct()
            inner.pending = _conjuncts(c.where)
            inner.pattern(p)
            new = [x for x in inner.rows.columns if x not in own]
            right = inner.rows.select(*[F.col(f"`{k}.__gid`").alias(f"__k{i}") for i, k in enumerate(keys)], *[F.col(f"`{x}`") for x in new])
            cond = [self.col(k, "__gid").eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
            both = cond[0]
            for x in cond[1:]:
                both = both & x
            self.rows = self.rows.join(right, both, "left").drop(*[f"__k{i}" for i in range(len(keys))])
            self.labels |= inner.labels
            self.edges |= inner.edges
            self.paths |= inner.paths

    def count_columns(self, e) -> None:
        """count{..} patterns in an expression become columns, by an aggregate and a left join."""
        if isinstance(e, tuple) and e and e[0] == "countof":
            p = e[1]
            name = f"__count{id(p)}"
            if name in self.rows.columns:
                return
            first = p.nodes[0].var in self.labels
            node = p.nodes[0] if first else p.nodes[1]
            edges = self.rel_rows(p.rels[0], p.nodes[0].label or self.labels.get(p.nodes[0].var), p.nodes[1].label or self.labels.get(p.nodes[1].var))
            sums = edges.groupBy(F.col("__src" if first else "__dst").alias("__g")).agg(F.count(F.lit(1)).alias(name))
            self.rows = self.rows.join(sums, self.col(node.var, "__gid") == F.col("__g"), "left").drop("__g").withColumn(name, F.coalesce(name, F.lit(0)))
        elif isinstance(e, (tuple, list)):
            for x in e:
                self.count_columns(x)

    def value(self, e: tuple) -> Column:
        kind = e[0]
        two = {"=": "__eq__", "<>": "__ne__", "<": "__lt__", ">": "__gt__", "<=": "__le__", ">=": "__ge__", "+": "__add__", "-": "__sub__", "*": "__mul__", "%": "__mod__", "and": "__and__", "or": "__or__"}
        if kind in two:
            return getattr(self.value(e[1]), two[kind])(self.value(e[2]))
        if kind == "/":
            return F.floor(self.value(e[1]) / self.value(e[2]))
        if kind == "not":
            return ~self.value(e[1])
        if kind == "null":
            return self.value(e[1]).isNull()
        if kind in ("starts", "ends", "contains"):
            return getattr(self.value(e[1]), {"starts": "startswith", "ends": "endswith", "contains": "contains"}[kind])(self.value(e[2]))
        if kind == "in":
            if e[2][0] == "list":
                return self.value(e[1]).isin(*[self.constant(x) for x in e[2][1]])
            if e[2][0] == "param":
                return self.value(e[1]).isin(*self.params[e[2][1]])
            return F.array_contains(self.value(e[2]), self.value(e[1]))
        if kind == "lit":
            return F.lit(e[1])
        if kind == "param":
            return F.lit(self.constant(e))
        if kind == "list":
            return F.array(*[self.value(x) for x in e[1]])
        if kind == "index":
            return F.get(self.value(e[1]), self.value(e[2]))
        if kind == "countof":
            return F.col(f"__count{id(e[1])}")
        if kind == "prop" and e[1][0] == "name":
            var, prop = e[1][1], e[2]
            if f"{var}.{prop}" not in self.rows.columns and f"{var}.{prop}" not in self.joining:
                if var in self.scalars:
                    return F.col(f"`{var}`").getField(prop)
                if var not in self.bound():
                    raise CypherError(f"unknown variable {var}")
                return F.lit(None).cast("string")
            return self.col(var, prop)
        if kind == "name":
            return self.whole(e[1])
        if kind == "call":
            return self.call(e[1], e[2], e[3])
        raise CypherError(f"unsupported expression {kind}")

    def constant(self, e: tuple):
        if e[0] == "lit":
            return e[1]
        if e[0] == "param":
            if e[1] not in self.params:
                raise CypherError(f"missing parameter {e[1]}")
            return self.params[e[1]]
        raise CypherError("expected a constant")

    def whole(self, var: str) -> Column:
        if var in self.scalars:
            return F.col(f"`{var}`")
        if var in self.paths:
            return F.struct(self.col(var, "path").alias("nodes"), self.col(var, "length").alias("length"))
        if var in self.labels or var in self.edges:
            own = [c for c in self.rows.columns if c.startswith(f"{var}.") and not c.startswith(f"{var}.__")]
            return F.struct(*[F.col(f"`{c}`").alias(c.split(".", 1)[1]) for c in own])
        raise CypherError(f"unknown variable {var}")

    def call(self, name: str, args: list, distinct: bool) -> Column:
        if name == "count":
            if args[0][0] == "star":
                return F.count(F.lit(1))
            inner = args[0]
            counted = self.identity(inner[1]) if inner[0] == "name" and inner[1] not in self.scalars else self.value(inner)
            return F.count_distinct(counted) if distinct else F.count(counted)
        if name == "collect":
            return F.array_sort(F.collect_set(self.value(args[0])) if distinct else F.collect_list(self.value(args[0])))
        if name in ("min", "max", "sum", "avg"):
            return getattr(F, name)(self.value(args[0]))
        first = args[0] if args else None
        if name == "length" and first[0] == "name" and first[1] in self.paths:
            return self.col(first[1], "length")
        if name == "labels" and first[0] == "name":
            return F.array(self.col(first[1], "__label"))
        if name == "label" and first[0] == "name":
            return self.col(first[1], "__label")
        if name == "type" and first[0] == "name":
            return self.col(first[1], "__type")
        if name == "id" and first[0] == "name":
            return self.identity(first[1])
        if name == "exists":
            return self.value(first).isNotNull()
        if name == "split":
            return F.split(self.value(first), re.escape(self.constant(args[1])))
        if name in ("size", "length"):
            e = self.value(first)
            kind = "array" if first[0] in ("list",) or first[0] == "call" and first[1] in ("split", "collect", "labels") else "text"
            return F.size(e).cast("long") if kind == "array" else F.length(e).cast("long")
        if name in ("lower", "tolower"):
            return F.lower(self.value(first))
        if name in ("upper", "toupper"):
            return F.upper(self.value(first))
        if name == "coalesce":
            return F.coalesce(*[self.value(a) for a in args])
        raise CypherError(f"unknown function {name}")

    def identity(self, var: str) -> Column:
        if var in self.labels:
            return self.col(var, "__gid")
        if var in self.edges:
            return self.col(var, "__type")
        return self.col(var, "length")

    def project(self, c: Clause) -> None:
        if self.rows is None:
            raise CypherError("nothing is matched")
        for i in c.items:
            self.count_columns(i.expr)
        grouped = any(_aggregates(i.expr) for i in c.items)
        kept = [i for i in c.items if i.expr[0] == "name" and i.expr[1] not in self.scalars] if c.kind == "with" else []
        plain = [i for i in c.items if i not in kept]
        carried = [x for i in kept for x in self.rows.columns if x.split(".")[0] == i.expr[1]]
        keys = [F.col(f"`{x}`") for x in carried] + [self.value(i.expr).alias(i.name) for i in plain if not _aggregates(i.expr)]
        # Sort keys that are neither outputs nor aggregates are carried along, hidden.
        named = {repr(i.expr): i.name for i in c.items} | {repr(("name", i.name)): i.name for i in c.items}
        hidden, order = [], []
        for n, (e, up) in enumerate(c.order):
            if repr(e) in named and (c.kind == "return" or repr(e) in {repr(i.expr) for i in plain} | {repr(("name", i.name)) for i in plain}):
                key = F.col(f"`{named[repr(e)]}`")
            elif grouped or c.distinct:
                key = F.col(f"`{e[1][1]}.{e[2]}`") if e[0] == "prop" else None
                if key is None or f"{e[1][1]}.{e[2]}" not in carried:
                    raise CypherError("ORDER BY must name a result here")
            else:
                hidden.append(self.value(e).alias(f"__o{n}"))
                key = F.col(f"__o{n}")
            order.append(key.asc_nulls_last() if up else key.desc_nulls_last())
        if grouped:
            sums = [self.value(i.expr).alias(i.name) for i in plain if _aggregates(i.expr)]
            out = self.rows.groupBy(*keys).agg(*sums)
            out = out.select(*[F.col(f"`{x}`") for x in carried], *[F.col(f"`{i.name}`") for i in plain])
        else:
            out = self.rows.select(*keys, *hidden)
            out = out.distinct() if c.distinct else out
        if c.kind == "with":
            self.labels = {i.name: self.labels[i.expr[1]] for i in kept if i.expr[1] in self.labels}
            self.edges = {i.name: self.edges[i.expr[1]] for i in kept if i.expr[1] in self.edges}
            self.paths = {i.name for i in kept if i.expr[1] in self.paths}
            self.scalars = {i.name for i in plain}
            renames = {x: i.name + x[len(i.expr[1]) :] for i in kept for x in carried if x.split(".")[0] == i.expr[1] and i.name != i.expr[1]}
            out = out.withColumnsRenamed(renames) if renames else out
        self.rows = out
        if c.kind == "with" and c.where is not None:
            for e in _conjuncts(c.where):
                self.filter(e)
        if order:
            self.rows = self.rows.orderBy(*order)
        if c.skip is not None:
            self.rows = self.rows.offset(int(self.constant(c.skip)))
        if c.limit is not None:
            self.rows = self.rows.limit(int(self.constant(c.limit)))
        if hidden:
            self.rows = self.rows.drop(*[f"__o{n}" for n in range(len(c.order))])


def run(catalog: GraphCatalog, text: str, params: dict | None = None) -> DataFrame:
    """The result of a query as a DataFrame; CypherError if it is not in the language."""
    clauses = Parser(text).query()
    if clauses[0].kind == "call":
        from pyspark.sql import SparkSession

        spark = SparkSession.getActiveSession()
        called = clauses[0].items[0].expr[1].lower()
        if called == "show_tables":
            return spark.createDataFrame(catalog.tables(), "name string, type string")
        if called == "schema.info" or called.endswith(".schema.info"):
            return spark.createDataFrame(catalog.columns(), "name string, type string, column string, data_type string")
        raise CypherError("unknown procedure")
    words = tokens(text)
    named = {b.text.strip("`") for a, b in zip(words, words[1:]) if a.text == "." and b.kind == "name"} | {a.text.strip("`") for a, b in zip(words, words[1:]) if a.kind == "name" and b.text == ":"}
    plan = Planner(catalog, params or {}, tuple(sorted(named)))
    named = {p.path for c in clauses for p in c.patterns if p.path}
    plan.path_values = any(i.expr == ("name", n) for c in clauses for i in c.items for n in named)
    plan.valued = set().union(*(_valued([*[i.expr for i in c.items], c.where, [e for e, _ in c.order]]) for c in clauses))
    for n, c in enumerate(clauses):
        if c.kind in ("match", "optional"):
            after = next((x for x in clauses[n:] if x.kind in ("with", "return")), None)
            plan.once = after is not None and (after.distinct or any(_aggregates(i.expr) for i in after.items)) and not any(_counts(i.expr) for i in after.items)
            plan.match(c)
        else:
            if plan.rows is None:
                from pyspark.sql import SparkSession

                plan.rows = SparkSession.getActiveSession().range(1).select(F.lit(0).alias("__one"))
            plan.project(c)
    return plan.rows
