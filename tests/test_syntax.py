"""Sources read by grammar or tokens."""

import pytest

from quarry.index import CodeIndex
from quarry.operators import syntax
from quarry.operators.braces import Source

GO = """package pay

// Charge f(x)
type (
	Ledger interface {
		Pay(q int) error
	}
	Entry[T any] struct { A T }
	Alias = int
)
type ID string

func (s *Service) ProcessPayment(q int) (r interface{}, err error) {
	if (q > 0) {
		s.repo.record(q, "a(b)")
	}
	x := []byte(q)
	defer func() { done() }()
	(helper)(1)
	type body struct {
		n int
	}
	return fmt.Sprintf(`raw(`, len(x)), nil
}

func Outer() {
	ProcessPayment(1)
}
func noBody(x int) int
"""
TS = """import { a } from "b";
export async function load(x: number): Promise<{a: number}> {
  const y = await fetch(`/u/${id(x)}/v`), z = [1, 2].map((q) => q + 1);
  return y.json<T>(z);
}
export class Client extends Base {
  constructor(private a: string) { super(a); }
  get(path: string): Promise<void> {
    if (a) { return this.request("GET", path); }
    return obj[key](1) / 2 / f(3);
  }
}
interface Shape { area(): number; }
export const handler = async (req: Request) => {
  const re = /a(b/;
  new Foo(bar());
  next?.();
};
const o = { m() { return 1; }, n: call(2) };
"""


def test_go():
    s = Source(GO, "go")
    assert s.errors == []
    got = [(d[0], d[1], d[3], d[4], GO[d[5] : d[6]].split("\n")[0][:14]) for d in s.definitions()]
    assert got == [
        ("Ledger", "interface", 5, 7, "Ledger interfa"), ("Entry", "type", 8, 8, "Entry[T any] s"), ("ID", "type", 11, 11, "ID string"), ("ProcessPayment", "function", 13, 24, "func (s *Servi"),
        ("body", "type", 20, 22, "body struct {"), ("Outer", "function", 26, 28, "func Outer() {"), ("noBody", "function", 29, 29, "func noBody(x "),
    ]
    assert GO.encode()[s.definitions()[3][6] - 1 :][:1] == b"}"
    assert s.calls() == [("record", 15, 10), ("done", 18, 17), ("helper", 19, 3), ("Sprintf", 23, 13), ("len", 23, 29), ("ProcessPayment", 27, 2)]


def test_typescript():
    s = Source(TS, "ts")
    assert s.errors == []
    got = [(d[0], d[1], d[3], d[4]) for d in s.definitions()]
    assert got == [("load", "function", 2, 5), ("y", "const", 3, 3), ("z", "const", 3, 3), ("Client", "class", 6, 12), ("Shape", "interface", 13, 13), ("handler", "const", 14, 18), ("re", "const", 15, 15), ("o", "const", 19, 19)]
    assert s.calls() == [("fetch", 3, 19), ("id", 3, 31), ("map", 3, 54), ("json", 4, 12), ("request", 9, 26), ("obj", 10, 12), ("f", 10, 30), ("bar", 16, 11), ("next", 17, 3), ("call", 19, 35)]


@pytest.mark.parametrize(("source", "language", "errors"), [
    ("func a() {\n\tb(\n}\n", "go", ["missing )"]), ('x = "abc\ny', "ts", ['missing "']), ("a)", "go", [")"]), ("f([)", "ts", ["missing ]"]), ("{{", "go", ["missing }", "missing }"]),
    ("/* x", "go", ["missing */"]), ("`a${b(}`", "ts", ["missing )"]), ("x := `a", "go", ["missing `"]), ("", "go", []), ("// (\nvar s = '(' ", "go", []), ("é(", "ts", ["missing )"]),
])
def test_errors(source, language, errors):
    assert [m for _, m in Source(source, language).errors] == errors


def test_bytes_after_letters_of_many_bytes():
    text = "package x\n// é\nfunc É() {\n\té := ñ(1)\n}\n"
    (d,) = Source(text, "go").definitions()
    assert text.encode()[d[5] : d[6]].decode() == "func É() {\n\té := ñ(1)\n}"
    assert Source(text, "go").calls() == [("ñ", 4, 8)]


def test_python_bounds_hold_decorators():
    text = "é = 1\n@a.b(\n  c)\nclass K:\n    async def m(self):\n        return self.x(y())\n"
    got = syntax.definitions_of("k.py", text)
    assert [(d[0], d[2], d[3], d[4]) for d in got] == [("K", 4, 2, 6), ("m", 5, 5, 6)]
    assert text.encode()[got[0][5] : got[0][6]].decode() == text[6:-1] and text.encode()[got[1][5] :].startswith(b"async def m")
    assert syntax.calls_of("k.py", text) == [("b", 2, 4), ("x", 6, 21), ("y", 6, 23)]
    assert syntax.errors_of("k.py", "def (:\n")[0][0] == 1 and syntax.errors_of("k.py", text) == []


def test_index_by_grammar(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/pay.go").write_text(GO)
    (tmp_path / "t/web.ts").write_text(TS)
    (tmp_path / "t/data.rs").write_text("fn x() {}")
    (tmp_path / "t/bad.go").write_text("func a() {\n")
    index = CodeIndex(spark, f"{tmp_path}/i", f"{tmp_path}/t", indexer="grammar")
    index.reconcile()
    bounds = {r.name: (r.start_line, r.end_line) for r in index.outline("pay.go").collect()}
    assert bounds["ProcessPayment"] == (13, 24) and bounds["body"] == (20, 22)
    # the call after the nested type belongs to the function, and the declaration is no call
    assert [(r.line, r.enclosing_name) for r in index.find_callers("Sprintf").collect()] == [(23, "ProcessPayment")]
    assert [(r.line, r.enclosing_id) for r in index.find_callers("ProcessPayment").collect()] == [(27, "pay.go#function#Outer#26")]
    assert index.read_symbol("pay.go#function#Outer#26") == "26\tfunc Outer() {\n27\t\tProcessPayment(1)\n28\t}"
    row = index.check_file("bad.go").first()
    assert not row.ok and [(e.line, e.message) for e in row.errors] == [(2, "missing }")]
    with pytest.raises(syntax.Unsupported):
        index.check_file("data.rs")
    with pytest.raises(ValueError):
        CodeIndex(spark, "x", indexer="ctags")
