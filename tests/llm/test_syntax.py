"""Derivative parsing against the languages' own rules."""

import ast
import random
import warnings

import pytest

from codeweft.llm import syntax as S
from codeweft.parsing.derivatives import Grammar, Parser

GOOD = {
    "python": [
        "def f(a, /, b=1, *c, d: int = 2, **e) -> int:\n    return a if b else [x async for x in y if (z := x)]\n", "async def f():\n    async with a as b, c:\n        await d\n    return\n", "match x:\n    case {'a': [1, *_], **r} if r:\n        pass\n    case P(a=1) | None as q:\n        pass\n",
        "try:\n\tx\nexcept* (A, B) as e:\n\traise C from e\nelse:\n\tpass\nfinally:\n\tpass\n", 'f"{a!r:>{w}} {{x}} {d["k"]} {x = }" f\'\'\'{\n1}\'\'\'\n', "x: list[int] = [*a, 1]; y += 1; del x[0], (y)\n", "@a.b(1)\nclass A(B, metaclass=C):\n    x = lambda *a, k=1: (yield)\n",
        "type X[T] = list[T]\nmatch = case = type = 1\nprint(match, 0x1F, 1_0.5e3j, b'\\x00', ...)\n", "if a:\n  b\nelif c: d\nelse:\n    e\n", "def f():\n        x\n        if y:\n          z\n", "for x, in y: pass\nwhile 1: break\n", "# only\n\n", "with (a as b, c as d,): pass\n",
    ],
    "javascript": [
        "async (a, {b, c: [d = 1], ...e}) => { for await (const x of y) z?.[0]?.(x) ?? 1; }", "const f = x => ({ a: x, get b() { return 1 }, async *[c]() {}, d, ...e })", "let a = 1\nlet b = a\n++b\n", "class A extends B { #p = 1; static { x() } get q() { return this.#p } constructor() { super() } }",
        "x = /[/{(]+/g.test(y) ? `a${`b${c}`}d` : a / b / c", "label: for (let i = 0, j; i < 3; i++) { if (a) continue label; else break }", "switch (a) { case 1: b(); default: c() }", "import a, { b as c } from 'd'\nexport default function () {}\nexport const e = 1", "do x(); while (y) z()",
        "var async = 1, of = 2; async = of; if (a) b\nelse c", "return_ = function* () { yield* a; yield\nb }", "a = b ? function () {} : class {}; delete a['x'], void 0, typeof b; new A.B(1).c`t`", "x = 10_000n ** 5n; y ||= 0.5e3; ({ a: b } = c);", "try { a } catch { b } finally { c }", "// c\n/* d */",
    ],
    "c": [
        '#include <a.h>\n#define X(a) do { \\\n  b(a); \\\n} while (0)\nstatic int f(const char *s, struct t *p, ...) {\n  unsigned long n = sizeof(*p), m[3] = {[0] = 1, 2};\n  for (int i = 0; i < 3; i++) { s++; }\n  if (!p->x) return -1;\n  T *q = (T *)p; q->a.b[1] = n << 2 ? \'\\n\' : 0x1F;\n  do { goto out; } while (0);\nout:\n  return (int)n;\n}',
        "typedef struct { int a : 3; union { float f; }; } S, *P;\nenum E { A = 1, B, };\nint (*fp)(int, void (*)(void));\nextern const char *const names[];\n_Static_assert(1, \"x\");", "#if 0\nthis is ) not ( code '\n#endif\nvoid g(void);", 'int a = 1;\n#ifdef X\nint b(\n#else\nint b;\n#endif\n'.replace("int b(\n", "int b;\n"), "switch_t x; void f() { switch (a) { case 1: default: break; } }",
    ],
    "cpp": [
        'template <typename T, int N = 3>\nclass A : public B<T>, private C {\n public:\n  explicit A(int a) : B<T>(a), b_{a} {}\n  virtual ~A() = default;\n  bool operator==(const A& o) const noexcept override { return a_ < o.a_ && b_ > 3; }\n private:\n  std::map<int, std::vector<std::pair<int, T>>> m_;\n  static constexpr int k = 1;\n};',
        "auto f(const std::string& s, Foo* p) -> int {\n  auto g = [&, x = std::move(s)](auto&& y) mutable { return y >> 2; };\n  for (const auto& [k, v] : m) { if (auto it = m.find(k); it != m.end()) throw std::runtime_error(\"x\"); }\n  try { auto q = std::make_unique<Foo>(1, \"a\"); q->run(); } catch (const std::exception& e) { return static_cast<int>(1.5f); } catch (...) {}\n  return new int[3]{1, 2} ? 1'000 : 0b11;\n}",
        'namespace a::b { using T = int; enum class E : int { X, Y }; }\nusing namespace std;\nauto s = R"x(( { " )x";\nint A::f() const { return this->x; }', "std::vector<Mount> a(67);\nx::y<z> w{1};\nunsigned long long q = 1ull;",
    ],
}
BAD = {
    "python": ["def f(:\n  pass\n", "x = (1\n", "if a\n    b\n", "def f():\nreturn 1\n", "  x\ny\n", "x = 'a\n", "<<<<<<< HEAD\nx\n=======\ny\n>>>>>>> b\n", "f'{a'\n", "x = 1n\n", "print 'a'\n", "x = “a”\n", "a = b = \n", "f(a=1, 2)\n", "f() = 1\n", "x = 012\n", "function f() {}\n", "def f():\n", "a +\n", "else:\n  x\n", "if x:\n\ty\n        z\n"],
    "javascript": ["function f( {", "if (a { b }", "const x;", "let a = ;", "retrun x;", "x = 'a\n'", "{ a: 1, b: 2 }", "def f(x):\n  return x", "a b", "x = `a${b", "<<<<<<< HEAD\na\n", "function f() { return 1; }}", "for (;;", "x => { a: }", "int main() { return 0; }", "a = “b”;", "/* open"],
    "c": ["int f( {}", "int f() { return 1 }", "int f() { a( ; }", "def f(x):\n    return x\n", "int f() { if (a) }", "int x = ;", "int f() {", "char *s = \"a\n\";", "std::string f() { }", "#if 1\nint x;\n", "int f() { <<<<<<< a\n }", "int f() { x = “a”; }", "#endif\n"],
    "cpp": ["class A { int x }", "auto f() { return [](int a) { return a; }", "std::vector<int x;", "int f() { std::cout << ; }", "template <typename T", "void f() { a.b(]; }", "def f(self): pass\n", "int f() { auto x = \"a; }"],
}


@pytest.mark.parametrize(("language", "text"), [(g, t) for g, ts in GOOD.items() for t in ts])
def test_valid(language, text):
    assert S.check(text, language) is None
    assert S.check(text.replace("\n", "\r\n"), language) is None


@pytest.mark.parametrize(("language", "text"), [(g, t) for g, ts in BAD.items() for t in ts])
def test_invalid(language, text):
    assert S.check(text, language) is not None


def test_places():
    assert S.check("x = 1\ny = = 2\n", "python") == ("token", 10)
    assert S.check("function f() {\n  a();\n", "javascript") == ("cut off", 22)
    assert S.check("int a;\nint b = );\n", "c") == ("token", 15)


def test_python_as_the_interpreter_judges():
    """Own sources of the standard library, whole and damaged."""
    import importlib.util

    r = random.Random(7)
    warnings.simplefilter("ignore")
    for name in ("json.decoder", "dataclasses", "textwrap", "ast", "asyncio.tasks", "typing"):
        with open(importlib.util.find_spec(name).origin, encoding="utf-8") as f:
            text = f.read()
        assert S.check(text, "python") is None, name
        lines = text.split("\n")
        for _ in range(25):
            part = lines[(a := r.randrange(len(lines))) : a + r.randint(1, 40)]
            damaged = "\n".join(part)
            cut = r.randrange(len(damaged) + 1)
            damaged = damaged[:cut] + r.choice(["", "(", ")", ":", "'", "\n", "= ", "if "]) + damaged[cut + r.randint(0, 2) :]
            try:
                ast.parse(damaged)
                ok = True
            except (SyntaxError, ValueError):
                ok = False
            assert (S.check(damaged, "python") is None) == ok, damaged


def test_derivatives_of_an_ambiguous_grammar():
    g = Grammar("s: 'a' s 'b' | 'a' s | t*\nt: 'c' | 'c' 'd'?", "s")
    p = Parser(g)
    ids = {n[1]: i for n, i in g.ids.items() if n[0] == "'"}
    parse = lambda w: p.parse([ids[c] for c in w])
    assert [parse(w) for w in ("", "ab", "aacb", "cdcc", "aabb")] == [-1] * 5
    assert parse("aabbb") == 4 and parse("d") == 0 and parse("acdd") == 3


def test_rows(spark):
    s = spark.createDataFrame([(1, "r", "a.py", "PYTHON ", "x = ("), (1, "r", "a.py", "PYTHON ", "x = ("), (2, "r", "a.py", "python", "x = 1"), (3, "r", "b.c", "C", None), (4, "q", "b.c", "c", ""), (5, None, None, "cobol", "x ("), (6, "r", None, None, "x ("), (7, "r", "z.js", "JavaScript", "a = (" + "1," * 50_000)], "sample_id bigint, repo string, file_path string, language string, code string")
    p = spark.createDataFrame([(9, "a.py", "def f(:"), (10, "a.py", ""), (11, "none.py", "("), (12, "b.c", None), (13, "b.c", "int x;")], "patch_id bigint, file_path string, patched_code string")
    v = S.verdicts(S.records(s, p))
    assert {(r.kind, r.record_id) for r in v.where("verdict is not null").collect()} == {("sample", 1), ("sample", 7), ("patch", 9)}
    rates = {(r.repo, r.language): (r.n_texts, r.n_invalid) for r in S.rates(v).collect()}
    assert rates == {("r", "python"): (3, 2), ("r", "javascript"): (1, 1), ("q", "c"): (1, 0)}
    files = {(r.repo, r.file_path, r.language): (r.n_texts, r.n_invalid) for r in S.by_file(v).collect()}
    assert files == {("r", "a.py", "python"): (3, 2), ("r", "z.js", "javascript"): (1, 1), ("q", "b.c", "c"): (1, 0)}
    assert {r.record_id for r in S.records(s, p).where("kind = 'patch'").collect()} == {9, 11, 13}
    assert S.verdicts(S.records(s.limit(0), p.limit(0))).count() == 0
