import pytest

from quillstone.plans import imports
from quillstone.plans.compiler import Compiler, FormulaError
from quillstone.plans.queries_formulas import CLASS, IMPORTED, SCRIPT


def stages(text):
    c = Compiler()
    c.add("x", text)
    return [(s.plain, s.windows, s.folds) for s in c.stages], c.results["x"]


def test_bodies_end_at_their_brace():
    text = "def a(x) { return x } def b(x, y) { t = iif(x > 0, '}', 1); // }\n if (x) { y } return { x } }\ndef c() { open"
    assert imports.bodies(text, "a|b") == {"a": " return x ", "b": " t = iif(x > 0, '}', 1); // }\n if (x) { y } return { x } "}
    with pytest.raises(FormulaError, match="c: its brace"):
        imports.bodies(text)


def test_tokens_become_the_languages():
    for foreign, own in {
        "return move(close, 2) \\ open": "delay(C, 2) / O",
        "a = msum(vol, 5); a = a * 2; return a": "a := sum(V, 5); a := a * 2; a",
        "return mavg(close, 1..3)": "wav(C, 1, 2, 3)",
        "return iif(close > open && !(high == low), NULL, -1)": "iif(C > O and not H == L, null, -1)",
        "return ewmMean(close, 0.25)": "ema(C, 1, 0.25)",
        "return mbeta(close, indexclose, 20) + pow(low, 2)": "beta(C, IDX, 20) + L ** 2",
        "return mrank(close, false, 4) - mimax(high, 3)": "tsrank(C, 4) - argmax(H, 3)",
    }.items():
        assert stages(imports.script(foreign)) == stages(own), foreign


def test_methods_of_a_class():
    source = "class A(Base):\n  def one(this, k=1):\n    x = this.close.pow(2)\n    x = (x + this.returns).fillna(0).replace([1], 0)\n    return rank(x).abs().to_frame().CLOSE\n  def two(self):\n    return min(self.open, max(self.low, 3)).fillna(value=1)\n"
    got = imports.methods(source)
    assert stages(got["one"]) == stages("abs(rank(fill(C ** 2 + RET, 0)))") and stages(got["two"]) == stages("fill(pmin(O, pmax(L, 3)), 1)")
    assert set(imports.methods(source, "one")) == {"one"}


def test_twenty_foreign_texts_compile_to_the_registrys_columns():
    got = imports.methods(CLASS) | imports.scripts(SCRIPT)
    assert set(got) == set(IMPORTED) and len(got) == 20
    for name, text in got.items():
        windows = lambda t: sorted(sql for s, _ in [stages(t)] for _, w, _ in s for sql in w.values() if "OVER" in sql)
        assert len(windows(text)) == len(windows(IMPORTED[name])), name


@pytest.mark.parametrize("bad", ["return evil(close)", "return __import__('os')", "return close.__class__", "return [close]", "x = 1", "close[1] = 2; return close", "return unknown", "return mavg(close)", "return mavg(close, 1..3, 4)", "return lambda: 1", "return mrank(close, 2, 3)", "import os; return close", "return (close", "return 'text'"])
def test_what_isnt_on_the_list_is_refused(bad):
    with pytest.raises(FormulaError):
        stages(imports.script(bad))
    with pytest.raises(FormulaError):
        imports.methods("class A:\n def f(self):\n  return self.secret")
    with pytest.raises(FormulaError):
        imports.methods("class A:\n def f(self):\n  return self.close.tofile('x')")
