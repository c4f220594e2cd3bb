"""Reducers against hand-derived results, and properties of them."""

import difflib
import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from condensa.functions import levels as L
from condensa.operators import diffs, reducers as R


def test_runs():
    assert R.collapse_runs(["x", "x", "x", "", "x"], 1.0) == ["x", "[... 3 similar lines]", "", "x"]
    assert R.collapse_runs(["item 0", "item 1", "done"], 0.8) == ["item 0", "item 0", "done"]
    assert R.collapse_runs(["item 0", "item 1", "item 2", "done"], 0.8) == ["item 0", "[... 3 similar lines]", "done"]
    assert R.similarity("éa", "éb") == pytest.approx(1 / 3)


def test_output():
    got = R.reduce_output("\n".join(f"line {i}" for i in range(500)), "medium").split("\n")
    assert got[0] == "line 0" and got[79] == "line 79" and got[80:] == ["[... 420 more lines truncated]"]
    assert R.reduce_output("\x1b[31mred \x1b[0mx", "light") == "red x"


def test_summaries():
    log = ["test a ... ok", "test b ... ok", "test c ... FAILED", "boom", "", "test result: FAILED. 2 passed; 1 failed; 0 ignored"]
    got = R.test_summary(log, "medium").split("\n")
    assert got[:3] == ["[Test Summary] 2 passed, 2 failed, 0 skipped (4 total)", "", "Failures:"] and len(got) == 7
    assert R.test_summary(log[:4], "medium") is None
    assert R.compiler_summary(["error: x", "error: x", "warning: y", "error[E1]: z"], "medium").split("\n") == ["[Compiler Summary] 3 errors, 1 warnings", "", "Errors:", "  error: x", "  error[E1]: z", "  [... 1 more errors]"]


def test_json():
    assert json.loads(R.reduce_json("[0,1,2,3,4,5]", "medium")) == [0, 1, "... 1 more items (6 total)", 3, 4, 5]
    assert json.loads(R.reduce_json('{"a":{"b":{"c":1}}}', "aggressive")) == {"a": {"b": "{c}"}}
    assert R.reduce_json('{"a":', "light") == '{"a":'


def test_tools():
    tool = {"name": "t", "description": "d", "input_schema": {"properties": {"p": {"type": "string"}, "q": {}}}}
    assert json.loads(R.reduce_tools(json.dumps(tool), "aggressive")) == {"name": "t", "description": "d", "input_schema": "(p: string, q: any)"}
    many = [{"name": f"a__{i}"} for i in range(5)] + [{"name": "b__1"}, {"name": "b__2"}]
    assert R.reduce_tools(json.dumps(many), "aggressive").split("\n")[-1] == "[b] 2 tools: b__1, b__2"
    flat = R.reduce_tools(json.dumps([{"name": f"t{i}", "description": "x"} for i in range(7)]), "aggressive").split("\n")
    assert flat[5:] == ["  t5: x", "  t6: x"]


def test_turns():
    assert R.turn_score("``` error", 5, 10) == pytest.approx(0.7)
    assert R.turn_summary("User", ["User: hi", "a", "b"]) == "[User — 3 lines] User: hi"
    chat = "User: a\nAI: b\nUser: c\nAI: d"
    assert R.reduce_conversation(chat, "aggressive") == chat


@pytest.mark.parametrize(("n", "medium", "aggressive"), [(5, "full", "full"), (6, "full", "summary"), (11, "summary", "signature"), (31, "signature", "signature")])
def test_folds(n, medium, aggressive):
    assert (R.fold_decision(n, "medium"), R.fold_decision(n, "aggressive")) == (medium, aggressive)


def test_code():
    rust = "fn a() {\n" + '    let x = "}";\n' * 12 + "}\nfn b() {}\n"
    assert R.reduce_code(rust, "rust", "aggressive") == "fn a() { /* ... 14 lines */ }\nfn b() {}\n"
    python = "def f():\n" + "    x = 1\n" * 8
    assert "3 lines folded" in R.reduce_code(python, "python", "aggressive")
    assert R.reduce_code("let a = 1;\n", "go", "medium") == "let a = 1;\n"
    go = "func a() {\n" + "x()\n" * 30 + "}"
    assert R.reduce_code(go, "go", "aggressive") == "func a() { /* ... 31 lines */ }"


def test_function_bodies():
    """Declarations only, methods of Rust and Python too; types, strings and nested functions are no bodies of their own."""
    body = "{\n" + "  a();\n" * 12 + "}"
    folded = "{ /* ... 14 lines */ }"
    fold = lambda text, language: R.reduce_code(text, language, "aggressive")
    assert fold(f"export default async function f(a = {{}}) {body}", "javascript") == f"export default async function f(a = {{}}) {folded}"
    for kept in (f"const f = function g() {body}", f"const f = () => {body}", f"class A {{ m() {body} }}", f"function* g() {body}", f"call(function g() {body})", f"return function g() {body}"):
        assert R.fold_functions(kept, "javascript", "aggressive") is None, kept
    assert fold(f"const h = () => {{ function f() {body} }}", "javascript") == f"const h = () => {{ function f() {folded} }}"
    assert fold(f"function f(x: number): {{ a: number }} | {{ b: string }} {body}", "typescript") == f"function f(x: number): {{ a: number }} | {{ b: string }} {folded}"
    assert fold(f"function f(x: string): void;\nfunction f(x: any): Promise<void> {body}", "typescript") == f"function f(x: string): void;\nfunction f(x: any): Promise<void> {folded}"
    assert fold(f"impl A {{\n  pub(crate) async fn f<'a>(&'a self) -> Vec<u8> where T: Copy {body}\n}}", "rust") == f"impl A {{\n  pub(crate) async fn f<'a>(&'a self) -> Vec<u8> where T: Copy {folded}\n}}"
    assert R.function_bodies("trait T { fn f(&self); }\nlet g: fn(i32) = h;", "rust") == []
    assert fold('fn f() {\n  let s = "}}}";\n  // }\n' + "  fn g() {}\n" * 9 + "}", "rust") == "fn f() { /* ... 13 lines */ }"


@given(st.text(alphabet="ab\n", max_size=60), st.text(alphabet="ab\n", max_size=60))
def test_patches_round_trip(a, b):
    assert diffs.apply_patch(a, diffs.make_patch(a, b)) == b


@given(st.lists(st.sampled_from("abcdé"), max_size=12), st.integers(0, 12), st.integers(0, 3), st.lists(st.sampled_from("axyé"), max_size=3))
def test_patch_of_one_change(a, at, cut, put):
    """The way for a single changed place gives the matcher's patch, repeated lines included, and the size is the patch's."""
    b = a[:at] + put + a[at + cut :]
    base, new = "\n".join(a), "\n".join(b)
    want = ["--- original", "+++ modified"]
    for group in difflib.SequenceMatcher(None, base.split("\n"), new.split("\n"), autojunk=False).get_grouped_opcodes(3):
        i1, i2, j1, j2 = group[0][1], group[-1][2], group[0][3], group[-1][4]
        want.append(f"@@ -{i1 + 1},{i2 - i1} +{j1 + 1},{j2 - j1} @@")
        for tag, p, q, r, s in group:
            want += [" " + x for x in base.split("\n")[p:q]] if tag == "equal" else ["-" + x for x in base.split("\n")[p:q]] + ["+" + x for x in new.split("\n")[r:s]]
    text = "\n".join(want) + "\n"
    assert diffs.make_patch(base, new) == text
    assert diffs._patch_bytes(diffs._Lines(base), diffs._Lines(new)) == len(text.encode())


@given(st.text(max_size=200), st.sampled_from(L.LEVELS))
def test_any_text_reduces(text, level):
    for kind in ("command_output", "conversation", "json", "mcp_schema", "code:rust", "code:python", "code:java", "unknown"):
        assert isinstance(R.reduce_text(text, kind, level), str)


def test_names():
    assert L.parse_level("A") == "aggressive" and L.parse_language("tsx") == "typescript" and L.parse_type("mcp") == "mcp_schema"
    assert L.service_type("nonsense") == "unknown" and L.service_level(None) == "medium"
    with pytest.raises(ValueError):
        L.parse_level("x")
