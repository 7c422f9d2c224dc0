from plexgraph.parsers import REGISTRY, parse, register
from plexgraph.parsers.records import Parsed
from plexgraph.parsers.script import blanked


def kinds(p):
    out = {}
    for e in p.entities:
        out.setdefault(e.type, []).append(e.name)
    return out


def links(p, kind):
    return [x.target for x in p.links if x.type == kind]


def test_function_with_docstring():
    p = parse("a.py", 'def f(x):\n    "adds"\n    return x\n', "python")
    f = next(e for e in p.entities if e.type == "Function")
    assert not p.errors and kinds(p) == {"File": ["a.py"], "Module": ["a"], "Function": ["f"]} and f.props["docstring"] == "adds" and p.links


def test_class_with_methods_that_call():
    p = parse("a.py", "class A:\n    def x(self): return self.y()\n    def y(self): pass\n    def z(self): pass\n", "python")
    assert kinds(p)["Class"] == ["A"] and kinds(p)["Function"] == ["x", "y", "z"] and links(p, "CALLS") == ["?function:A.y"]


def test_imports():
    p = parse("a.py", "import os\nimport sys as s\nfrom a import b\nfrom c import d, e\nfrom . import f\n", "python")
    assert kinds(p)["Import"] == ["os", "s", "b", "d", "e", "f"]


def test_inheritance_and_abstract():
    p = parse("a.py", "from abc import ABC\nclass B(ABC): pass\nclass C(B): pass\nclass D(B, x.Y): pass\n", "python")
    assert links(p, "INHERITS") == ["?class:ABC", "?class:B", "?class:B", "?class:x.Y"]
    assert [e.props["is_abstract"] for e in p.entities if e.type == "Class"] == ["true", "false", "false"]


def test_variables_by_scope():
    p = parse("a.py", "LIMIT = 3\n_hidden = 1\nx: int = 2\ndef f():\n    a, b = 1, [2]\n", "python")
    got = {e.name: e.props for e in p.entities if e.type == "Variable"}
    assert set(got) == {"LIMIT", "a", "b"} and got["LIMIT"]["is_constant"] == "true" and got["a"]["is_global"] == "false" and got["LIMIT"]["type_annotation"] == "int"


def test_complexity_and_signature():
    p = parse("a.py", "def f(a, /, b: int, *c, d=1, **e) -> str:\n    if a and b or c: pass\n    for x in c:\n        with x: pass\n    try: pass\n    except E: pass\n    return [y for y in c if y]\n", "python")
    f = next(e for e in p.entities if e.type == "Function")
    assert f.props["complexity"] == "7" and f.props["signature"] == "(b: int, *c, **e)" and f.props["return_type"] == "str"


def test_decorators_and_nesting():
    p = parse("a.py", "class A:\n    @property\n    def f(self):\n        def g(): yield 1\n    @deco(1)\n    def h(self): pass\n", "python")
    assert links(p, "DECORATES") == [next(e.id for e in p.entities if e.name == "f")]
    assert len(links(p, "CLASS_CONTAINS_FUNCTION")) == 3
    assert next(e for e in p.entities if e.name == "f").props["is_property"] == "true"


def test_constant_annotations_and_nested_targets():
    p = parse("pkg/a.py", "def f(a: 'Foo', b: list[int]) -> None:\n    (x, [y, _z]), w.v = q\ndef g() -> 'pkg.Bar': return super().h('').i()\n@deco.x\ndef h(): pass\nfrom .m import n\nfrom .. import o\n", "python")
    f, g, _ = (e for e in p.entities if e.type == "Function")
    assert (f.props["signature"], f.props["return_type"], g.props["return_type"]) == ("(a: Foo, b: )", "None", "pkg.Bar")
    assert kinds(p)["Variable"] == ["x", "y"] and links(p, "CALLS") == ["?function:i", "?function:h", "?function:super"]
    mark = next(x for x in p.links if x.type == "DECORATES")
    assert mark.props == {"decorator_name": "deco.x", "line_number": "5"}
    assert [e.props["module_name"] for e in p.entities if e.type == "Import"] == ["m", ""] and links(p, "IMPORTS") == ["?module:pkg.m"] * 2


def test_counts_of_inner_functions_reach_the_outer_one():
    p = parse("a.py", "def f():\n    if a: pass\n    def g():\n        for x in y: yield x\n    return b and c\n", "python")
    f, g = (e for e in p.entities if e.type == "Function")
    assert (f.props["complexity"], g.props["complexity"]) == ("4", "2") and (f.props["is_generator"], g.props["is_generator"]) == ("true", "true")


def test_syntax_error_gives_one_error_and_no_entities():
    p = parse("a.py", "def f(:\n", "python")
    assert len(p.errors) == 1 and not p.entities


TS = """import { B, C as D } from './b';
// class Nope {}
@Component({ selector: 'app-a', templateUrl: './a.html', styleUrls: ['./a.css'] })
export class A extends Base implements I, J {
  @Input() size: number;
  constructor(private http: Http) { super(); }
  get v(): number { return this.n; }
  async load(id: string): Promise<void> { if (id) { this.save(id); helper("x{"); } }
  static save(x) { return x.y.z; }
}
export const f = (a, b) => a + b;
function* gen() { yield 1; }
async function go(q) { const [a, b] = q; return f(a, b) && /x{/.test(a); }
interface I { a: string; m(): void; }
enum E { P, Q = 2 }
type T = string | number;
"""


def test_typescript():
    p = parse("src/a.component.ts", TS, "angular")
    k = kinds(p)
    assert k["Class"] == ["A"] and k["Method"] == ["load", "save"] and k["Constructor"] == ["constructor"] and k["Getter"] == ["v"]
    assert k["Interface"] == ["I"] and k["Enum"] == ["E"] and k["Type"] == ["T"] and k["ArrowFunction"] == ["f"] and k["GeneratorFunction"] == ["gen"] and k["Function"] == ["go"]
    assert k["AngularComponent"] == ["app-a"] and k["AngularInput"] == ["size"] and k["ArrayPattern"] == ["[a, b]"] and k["Export"] == ["A", "f"]
    assert links(p, "EXTENDS") == ["?class:Base"] and links(p, "IMPLEMENTS") == ["?interface:I", "?interface:J"]
    assert links(p, "USES_TEMPLATE") == ["?template:./a.html"] and links(p, "USES_STYLES") == ["?style:./a.css"] and links(p, "IMPORTS") == ["?file:src/b"] * 2 and links(p, "USES") == ["?name:B", "?name:C"]
    assert set(links(p, "CALLS")) == {"?function:A.save", "?function:helper", "?function:f", "?function:test"}
    assert next(e for e in p.entities if e.name == "load").line_start == 8


MORE = """@Component({
  selector: 'app-m', // template: 'no'
  template: `<b>{{ x }}</b>`, styles: ['b { c: d }'], standalone: true,
  imports: [One, Two],
})
class M {
  a = 1; private b?: string;
  readonly c: () => void = () => { let d = 5; };
  @Input({ required: true, alias: 'size' }) e!: number;
  get f() { return 1; }
  g(h, { i, j } = {}, ...k: any[]) { const l = `x`; let [n] = [...m]; var o = { p: 1 }, q; }
  constructor(private r: R) { }
}
@NgModule({ declarations: [M], providers: [] })
export class N extends a.B { }
const s = async (t) => t;
const u = function () { };
"""


def test_script_metadata():
    p = parse("m.ts", MORE, "angular")
    of = lambda name, kind: next(e.props for e in p.entities if e.name == name and e.type == kind)
    m = of("M", "Class")
    assert (m["method_count"], m["property_count"]) == ("3", "4") and of("N", "Class")["extends"] == "a.B" and of("N", "Class")["method_count"] == "0"
    c = of("app-m", "AngularComponent")
    assert (c["template"], c["has_inline_styles"], c["standalone"], c["imports"], c["class_name"], c["selector"]) == ("<b>{{ x }}</b>", "true", "true", "One,Two", "M", "app-m")
    n = of("N", "AngularModule")
    assert [n[f"has_{k}"] for k in ("declarations", "imports", "exports", "providers")] == ["true", "false", "false", "true"] and n["declarations"] == "M"
    assert of("e", "AngularInput")["input_name"] == "size" and of("e", "AngularInput")["required"] == "true"
    g = of("g", "Method")
    assert (g["parameter_count"], g["has_destructuring"], g["has_defaults"], g["has_rest_params"], g["has_type_annotations"], g["method_kind"]) == ("4", "true", "true", "true", "true", "method")
    assert of("constructor", "Constructor")["parameter_count"] == "1" and of("f", "Getter")["parameter_count"] == "0"
    var = {e.name: e.props for e in p.entities if e.type in ("Variable", "ArrayPattern")}
    assert var["l"]["has_template_literal"] == "true" and var["[n]"]["has_spread_operator"] == "true" and var["o"]["is_object_literal"] == "true" and var["o"]["declaration_type"] == "var"
    assert var["s"]["is_arrow_function_assignment"] == "true" and var["u"]["is_function_assignment"] == "true" and var["l"]["modern_js_complexity"] == "1" and var["[n]"]["modern_js_complexity"] == "2"
    arrow = of("s", "ArrowFunction")
    assert (arrow["function_style"], arrow["parameter_count"], arrow["is_async"]) == ("arrow", "1", "true")
    assert all(len(e.props.get("code_snippet", "")) <= 500 for e in p.entities) and m["code_snippet"].startswith("class M {")


def test_blanking_keeps_offsets():
    assert len(blanked(TS)) == len(TS) and "Nope" not in blanked(TS) and blanked("a = b / c; d = 'x}y';") == "a = b / c; d = '   ';"
    assert blanked("`a\n${b}` // z") == "` \n    `     "


def test_markup():
    assert links(parse("a.html", "<app-b></app-b><app-a/><app-b>", "html"), "USES_COMPONENT") == ["?selector:app-a", "?selector:app-b"]
    assert links(parse("s/a.scss", "@use './v';\n/* @import 'no'; */ @import \"../w\";", "css"), "IMPORTS_STYLE") == ["?style:../w", "?style:./v"]
    props = parse("s/a.component.scss", "/* {{ */ $a: 1px; @mixin m { } @function f() { } .x > .y { .z { w: $a } }\n:host { } ::ng-deep mat-card { }", "css").entities[0].props
    want = {"style_type": "scss", "is_component_style": "true", "variable_count": "1", "mixins": "m", "function_count": "1", "max_nesting_depth": "4", "host_selectors": "1", "deep_selectors": "1", "material_components": "mat-card"}
    assert {k: props[k] for k in want} == want and props["selectors"].split(",") == sorted(props["selectors"].split(",")) and ".x > .y" in props["selectors"]
    props = parse("a.html", "<app-a *ngIf='x' [p]='1' (e)='f()'>{{ v }}</app-a><mat-b>", "html").entities[0].props
    assert (props["template_type"], props["angular_directives"], props["custom_components"], props["material_components"], props["property_bindings"], props["interpolations"]) == ("angular", "*ngIf", "app-a", "mat-b", "1", "1")
    assert parse("a.html", "<p>plain</p>", "html").entities[0].props["template_type"] == "html"


def test_registry_takes_parsers_and_survives_them():
    def bad(path, text):
        raise RuntimeError("boom")

    register("odd", bad)
    assert parse("a", "", "odd").errors == ["RuntimeError: boom"] and parse("a", "", "unknown") == Parsed("a")
    del REGISTRY["odd"]
