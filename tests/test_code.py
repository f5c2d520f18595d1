import ast

import pytest

from lodex.operators import recovery, symbols
from lodex.operators.scanner import RULES, Tokens, scan_source

#: Language, text, and by name: lines, parameters, result, calls.
CASES = [
    ("javascript", 'class A { m(a, b = "}") { return `}${x}` + f(a); } get v() { return /[{]/.test(this.q.z(1)); } }\nexport default class extends B { }\nlet z = async ({p}, [q]) => { go(); };\n',
     {"A": (1, 1), "A.m": (1, 1, "a b", None, "f"), "A.v": (1, 1, "", None, "test this.q.z"), "z": (3, 3, "{p} [q]", None, "go")}),
    ("typescript", 'abstract class S<T> { private async run<U>(a: Map<string, U>, b?: number): Promise<U> { return this.x.y(a); }\n arrow = (n: number): string => "}".repeat(n); }\ninterface I { run(): void }\n',
     {"S": (1, 2), "S.run": (1, 1, "a b", "Promise<U>", "this.x.y"), "S.arrow": (2, 2, "n", "string", "repeat"), "I": (3, 3)}),
    ("go", 'func (r *Repo) Get(id, n int, s string) (string, error) { if r == nil { return "}", fmt.Errorf("{") }; return r.q.Run(id), nil }\ntype I interface { Get(a int) string }\n',
     {"Get": (1, 1, "id n s", "(string, error)", "fmt.Errorf r.q.Run"), "I": (2, 2)}),
    ("rust", "impl<T: Fmt> Show for Wrap<T> { fn show<'a>(&'a self, n: u8) -> String { let c = '{'; self.fmt(n); Wrap::new(c) } }\ntrait D { fn d(&self); fn e(&self) -> u8 { 2 } }\nstruct P(u8);\n",
     {"Wrap": (1, 1), "Wrap.show": (1, 1, "self n", "String", "self.fmt Wrap::new"), "D": (2, 2), "D.d": (2, 2, "self", None, ""), "D.e": (2, 2, "self", "u8", ""), "P": (3, 3)}),
    ("java", '@A("{")\npublic class C<T> extends B {\n  private final Map<String, T> m = new HashMap<>();\n  @Override\n  public <U> List<U> get(final Map<String, U> a, int... n) throws E { return this.m.call(a, x -> { z(); }); }\n  C(int q) { super(q); }\n  abstract int no();\n}\n',
     {"C": (2, 8), "C.get": (4, 5, "a n", "List<U>", "this.m.call z"), "C.C": (6, 6, "q", None, ""), "C.no": (7, 7, "", "int", "")}),
    ("csharp", 'namespace N { public class P { public int X { get; set; } = 3;\n public int Sum(int a, int b = 2) => Add(a, b);\n private static async Task<T> Go<T>(string s) { var q = @"}"; await s.Do(); } } }\n',
     {"P": (1, 3), "P.Sum": (2, 2, "a b", "int", "Add"), "P.Go": (3, 3, "s", "Task<T>", "s.Do")}),
    ("cpp", 'namespace n { class A : public B { public: A(int x) : x_(x), y{1} { init(); } int get() const override { return "}"[0]; } int d(int); }; }\nint A::run(const std::string& s, int k = 3) noexcept { return s.size() + n::f(k); }\n#define X {\ntemplate <typename T> T mx(T a, T b) { return a > b ? a : b; }\n',
     {"A": (1, 1), "A.A": (1, 1, "x", None, "init"), "A.get": (1, 1, "", "int", ""), "run": (2, 2, "s k", "int", "s.size n::f"), "mx": (4, 4, "a b", "T", "")}),
    ("kotlin", 'class A(val x: Int) : B() { fun f(a: String = "}", vararg b: Int): Int = g(a)\n  override fun h() { x.run { y() } } }\n', {"A": (1, 2), "A.f": (1, 1, "a b", "Int", "g"), "A.h": (2, 2, "", None, "y")}),
    ("scala", 'class A(x: Int) extends B { def f(a: Int)(b: String = "}"): Int = { g(a) }\n def h = x }\n', {"A": (1, 2), "A.f": (1, 1, "a", None, "g"), "A.h": (2, 2, "", None, "")}),
    ("swift", 'class A: B { func f(_ a: Int, with b: String = "}") -> Int { return g(a) } }\nprotocol P { func q(x: Int) -> Bool }\n', {"A": (1, 1), "A.f": (1, 1, "a b", "Int", "g"), "P": (2, 2), "P.q": (2, 2, "x", "Bool", "")}),
    ("php", '<?php\nabstract class A { abstract function q(int $z); public function f(?int $a, string $b = "}"): int { return $this->g($a) + H::i($b); } }\n', {"A": (2, 2), "A.q": (2, 2, "$z", None, ""), "A.f": (2, 2, "$a $b", "int", "$this->g H::i")}),
    ("ruby", 'class A < B\n  def f(a, *b)\n    return 1 if a\n    b.each do |x|\n      puts(x) unless x\n    end\n    while a do\n      g(a)\n    end\n  end\n  def self.h = i(1)\nend\nmodule M; def z; "end"; end; end\n',
     {"A": (1, 12), "A.f": (2, 10, "a b", None, "puts g"), "A.h": (11, 11, "", None, "i"), "M": (13, 13), "M.z": (13, 13, "", None, "")}),
    ("lua", 'local function a(x, y)\n  for i = 1, x do print(i) end\n  while x do b(x) end\n  if x then return "end" else c.d(y) end\nend\nfunction M.n.b() return function() z() end end\n', {"a": (1, 5, "x y", None, "b c.d"), "b": (6, 6, "", None, "z")}),
    ("shell", 'f() { echo "}"; if true; then g; fi; case $x in a) b;; esac; }\nfunction h { ls; }\n', {"f": (1, 1, "", None, ""), "h": (2, 2, "", None, "")}),
    ("c", 'static struct p *mk(struct p *q, int n) { if (n) { return mk(q, n - 1); } return "}" ? q : 0; }\nenum e { A, B };\nint x = f(3);\nint decl(int);\n', {"mk": (1, 1, "q n", "struct p *", "mk"), "e": (2, 2)}),
]


@pytest.mark.parametrize(("language", "text", "want"), CASES, ids=[c[0] for c in CASES])
def test_definitions_by_syntax(language, text, want):
    rows = {r["qualified_name"]: r for r in scan_source(language, "p", text)}
    assert set(rows) == set(want)
    for name, told in want.items():
        r = rows[name]
        shown = (r["start_line"], r["end_line"], " ".join(p["name"] for p in r["params"]), r["return_type"], " ".join(c["callee"] for c in r["calls"]))
        assert shown[: len(told)] == told, name


def test_what_functions_hold_is_inner():
    rows = scan_source("javascript", "p", "function g(x, ...r) { const h = y => k(y); class In { m() {} } if (x) { h(x); h(x); } }\n")
    assert [(r["kind"], r["qualified_name"], r["depth"], r["parent"]) for r in rows] == [("function", "g", 0, None), ("inner_function", "g.h", 1, "g"), ("inner_class", "g.In", 1, "g"), ("inner_method", "g.In.m", 2, "g.In")]
    assert [p["variadic"] for p in rows[0]["params"]] == [False, True] and {c["callee"]: c["n"] for c in rows[0]["calls"]} == {"k": 1, "h": 2}


@pytest.mark.parametrize("language", sorted(RULES))
def test_any_text_is_scanned(language):
    """Torn texts, brackets that don't match, strings and comments left open, and long lines end with rows that lie within the text."""
    for text in ["", "\n", "}", ")]}", "class", "class A", "fn", "function f(", "def f", "func (", '"', "'", "/*", "`", "a" * 100_000, "(" * 3000, "f(" * 500 + ")" * 400, "class A { f(x) { ( } }", "end end end", "enum class", "impl for {", "int f(a) :", "x = (", "<" * 200, *[c[1][:n] for c in CASES for n in range(0, len(c[1]), 7)]]:
        for r in scan_source(language, "p", text):
            assert 1 <= r["start_line"] <= r["end_line"] <= text.count("\n") + 1
        tokens = Tokens(RULES[language], text)
        assert all(a <= b < len(tokens) for a, b in tokens.close.items())


BROKEN = """import os
LIMIT = 3
def sound(a): return os.path(a)
x = (1,
y = 2
class Half(Base):
    size: int = 1
    @property
    def good(self):
        return 1
    def bad(self):
        if self
            return 2
    def also(self, n): return n
@deco
def torn(:
    pass
text = '''
def not_this():
'''
def last():
    def held(): pass
    z = = 1
    return held
"""


def test_sound_statements_stay():
    rows = symbols.parse_python("b.py", BROKEN)
    got = {(r["kind"], r.get("qualified_name") or r["name"]): r for r in rows if r["kind"] not in ("import", "error")}
    assert set(got) == {("module", "b.py"), ("constant", "LIMIT"), ("function", "sound"), ("class", "Half"), ("method", "Half.good"), ("method", "Half.bad"), ("method", "Half.also"), ("function", "torn"), ("function", "last"), ("inner_function", "last.held")}
    assert got["class", "Half"]["bases"] == ["Base"] and got["class", "Half"]["class_attrs"][0]["name"] == "size" and got["method", "Half.good"]["is_property"]
    assert (got["class", "Half"]["start_line"], got["class", "Half"]["end_line"], got["method", "Half.also"]["start_line"]) == (6, 14, 14)
    assert (got["function", "last"]["start_line"], got["function", "last"]["end_line"], got["function", "torn"]["start_line"]) == (21, 24, 16)
    told = next(r["error"] for r in rows if r["kind"] == "error")
    assert [e.split(":")[0].removeprefix("syntax error at ") for e in told.split("; ")] == ["L4", "L12", "L16", "L23"]


def test_errors_beyond_five_are_counted():
    assert recovery.told(["a", "b"]) == "a; b" and recovery.told(list("abcdefg")) == "a; b; c; d; e (+2 more)" and recovery.told([]) == ""
    tree, errors = recovery.recovered("x = 1 1\n" * 9 + "ok = 1\n")
    assert len(errors) == 9 and len(tree.body) == 1 and tree.body[0].lineno == 10


@pytest.mark.parametrize("text", ["\0", "def f():\n\tpass\n  x\n", "class A:\n  def f(self):\n    )\n", "(" * 50, "'''", "@a\n@b\n", "if x:\n  y = = 1\n", "def f():\n  '''\ndoc\n", "\r\nx = = 1\r\ny = 1\r\n"])
def test_any_python_gives_rows(text):
    rows = symbols.parse_python("p.py", text)
    assert rows[0]["kind"] == "error" and len({(r["kind"], r.get("qualified_name"), r.get("name")) for r in rows}) == len(rows)
    for r in rows:
        assert (r.get("start_line") or 1) <= (r.get("end_line") or r.get("start_line") or 1)
    with pytest.raises((SyntaxError, ValueError)):
        ast.parse(text)
