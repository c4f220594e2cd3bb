"""Reducers of one text, by type and level: ordered folds that run in one Arrow pass."""

from __future__ import annotations

import ast
import json
import re
from json.encoder import encode_basestring

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from condensa.functions.levels import LEVELS, LIMITS, ROLES

_ANSI = re.compile(r"\x1b\[[0-9;]*[A-Za-z]|\x1b\].*?\x07")


def split_lines(text: str) -> list[str]:
    parts = text.split("\n")
    ended, last = [p.removesuffix("\r") for p in parts[:-1]], parts[-1]
    return [*ended, last] if last else ended


def cut_bytes(text: str, limit: int) -> str:
    raw = text.encode()
    return text if len(raw) <= limit else raw[:limit].decode(errors="ignore") + "..."


# ---- command output


def similarity(a: str, b: str) -> float:
    if a == b:
        return 1.0
    return sum(map(str.__eq__, a, b)) / max(len(a.encode()), len(b.encode()))


def _alike(a: str, b: str, threshold: float) -> bool:
    """Whether the similarity reaches the threshold; lengths far apart or an exact threshold need no comparison."""
    if a == b:
        return True
    if threshold >= 1.0 or min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    return similarity(a, b) >= threshold


def collapse_runs(rows: list[str], threshold: float) -> list[str]:
    """Lines like the head of their run collapse; blank lines end runs and stay."""
    runs: list[list] = []  # [head or None for a blank, count]
    for row in (r.rstrip() for r in rows):
        if not row:
            runs.append([None, 1])
        elif runs and runs[-1][0] is not None and _alike(runs[-1][0], row, threshold):
            runs[-1][1] += 1
        else:
            runs.append([row, 1])
    out: list[str] = []
    for head, n in runs:
        out += [""] if head is None else [head] * n if n < 3 else [head, f"[... {n} similar lines]"]
    return out


def _has(line: str, *marks: str) -> bool:
    return any(m in line for m in marks)


def test_summary(rows: list[str], level: str) -> str | None:
    marked = any(_has(r, "test result:", "Tests:", "passed", "PASS", "FAIL") or r.startswith("ok ") or ("test " in r and _has(r, "... ok", "... FAILED")) for r in rows)
    if len(rows) < 5 or not marked:
        return None
    n = dict.fromkeys(("pass", "fail", "skip"), 0)
    failures, notes, capture = [], [], False
    for r in rows:
        kind = "pass" if _has(r, "... ok", "PASS") else "fail" if "FAIL" in r else "skip" if _has(r, "ignored", "skipped", "pending") else None
        if kind:
            n[kind] += 1
            if kind == "fail":
                failures.append(r)
                capture = True
        elif _has(r, "test result:", "Tests:"):
            notes.append(r)
        elif capture:
            failures.append(r)
            capture = bool(r.strip()) and len(failures) <= 20
    out = [f"[Test Summary] {n['pass']} passed, {n['fail']} failed, {n['skip']} skipped ({sum(n.values())} total)"]
    if failures:
        most = LIMITS["test_failures"][level]
        out += ["", "Failures:", *("  " + f for f in failures[:most])]
        if len(failures) > most:
            out.append(f"  [... {len(failures) - most} more failure lines]")
    return "\n".join(out + notes)


def compiler_summary(rows: list[str], level: str) -> str | None:
    errors = [r.strip() for r in rows if _has(r, "error[", "error:")]
    warnings = sum(_has(r, "warning:", "warn[") for r in rows)
    if len(errors) + warnings < 3:
        return None
    shown = list(dict.fromkeys(errors))[: LIMITS["compiler_errors"][level]]
    out = [f"[Compiler Summary] {len(errors)} errors, {warnings} warnings"]
    if shown:
        out += ["", "Errors:", *("  " + e for e in shown)]
        if len(errors) > len(shown):
            out.append(f"  [... {len(errors) - len(shown)} more errors]")
    return "\n".join(out)


def reduce_output(text: str, level: str) -> str:
    rows = split_lines(_ANSI.sub("", text))
    for summary in (test_summary, compiler_summary):
        if (got := summary(rows, level)) is not None:
            return got
    rows, most = collapse_runs(rows, LIMITS["output_similarity"][level]), LIMITS["output_lines"][level]
    return "\n".join(rows if len(rows) <= most else [*rows[:most], f"[... {len(rows) - most} more lines truncated]"])


# ---- conversations


def parse_turns(text: str) -> list[tuple[str, list[str]]]:
    turns: list[tuple[str, list[str]]] = []
    for line in split_lines(text):
        if line.startswith(tuple(ROLES)):
            turns.append((line.split(":", 1)[0], [line]))
        elif turns:
            turns[-1][1].append(line)
        else:
            turns.append(("", [line]))
    return turns


def turn_score(raw: str, index: int, total: int) -> float:
    score = index / total * 0.3
    score += 0.3 if "```" in raw else 0.0
    score += 0.15 if _has(raw, ".rs", ".ts", ".py", ".js", "/src/", "\\src\\") else 0.0
    score += 0.2 if _has(raw, "I'll ", "Let's ", "We should", "The fix is", "I've decided", "Going with") else 0.0
    score += 0.25 if _has(raw, "error", "Error", "failed", "FAILED", "panic") else 0.0
    return min(score, 1.0)


def scored_turn(raw: Column, index: Column, total: Column) -> Column:
    """turn_score of a column of turns; a null text has recency only."""

    @F.pandas_udf("double")
    def run(texts: pd.Series, at: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([turn_score(t or "", i, k) for t, i, k in zip(texts, at, n, strict=True)], dtype="float64")

    return run(raw, index, total)


def trim_turn(rows: list[str], level: str) -> str:
    most, out, fenced = LIMITS["turn_lines"][level], [], False
    if len(rows) <= most:
        return "\n".join(rows)
    for r in rows:
        fence = "```" in r
        fenced ^= fence
        if fence or fenced or _has(r, "error", "fix", "/") or r.startswith(("- ", "* ", "#")) or len(out) < most:
            out.append(r)
    return "\n".join(out if len(out) >= len(rows) else [*out, "[... trimmed]"])


def turn_summary(role: str, rows: list[str]) -> str:
    return f"[{role} — {len(rows)} lines] {cut_bytes(rows[0], 100)}"


def reduce_conversation(text: str, level: str) -> str:
    turns = parse_turns(text)
    n = len(turns)
    if n <= 4:
        return text
    out = []
    for i, (role, rows) in enumerate(turns):
        raw = "\n".join(rows)
        if i == 0 or i >= n - LIMITS["recent_turns"][level]:
            out.append(raw)
        elif turn_score(raw, i, n) >= LIMITS["turn_score"][level]:
            out.append(trim_turn(rows, level))
        else:
            out.append(turn_summary(role, rows))
    return "\n\n".join(out)


# ---- JSON and tool schemas


def load_json(text: str):
    def no(_):
        raise ValueError("no JSON number")

    return json.loads(text, parse_constant=no)


def dump(value, pretty: bool = True) -> str:
    """JSON text with sorted keys; pretty: line breaks and two spaces for each depth."""
    if pretty:
        return _indented(value, "\n")
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def _indented(value, line: str) -> str:
    kind = type(value)
    if kind is str:
        return encode_basestring(value)
    if kind is int:
        return repr(value)
    if not value or kind not in (dict, list):
        return json.dumps(value)
    inner = line + "  "
    if kind is dict:
        return "{" + inner + ("," + inner).join([f"{encode_basestring(k)}: {_indented(value[k], inner)}" for k in sorted(value)]) + line + "}"
    return "[" + inner + ("," + inner).join([_indented(v, inner) for v in value]) + line + "]"


def sample_json(value, depth: int, level: str):
    kind = type(value)
    if kind is list:
        n, most = len(value), LIMITS["json_items"][level]
        if n > most:
            head = max(most // 2, 1)
            marker = f"... {n - most} more items ({n} total)"
            inner = [sample_json(v, depth + 1, level) for v in (*value[:head], *value[n - most + head :])]
            return [*inner[:head], marker, *inner[head:]]
        return [sample_json(v, depth + 1, level) for v in value]
    if kind is dict:
        keys = sorted(value)
        if depth >= LIMITS["json_depth"][level]:
            names = ", ".join(keys[:5])
            return f"{{...{len(keys)} keys: {names}, ...}}" if len(keys) > 5 else f"{{{names}}}"
        return {k: sample_json(value[k], depth + 1, level) for k in keys}
    return value


def reduce_json(text: str, level: str) -> str:
    try:
        return dump(sample_json(load_json(text), 0, level))
    except (ValueError, RecursionError):
        return text


def without_descriptions(value):
    if isinstance(value, dict):
        return {k: without_descriptions(v) for k, v in value.items() if k != "description"}
    return [without_descriptions(v) for v in value] if isinstance(value, list) else value


def reduce_schema(schema, level: str):
    if level == "medium":
        return without_descriptions(schema)
    props = schema.get("properties") if isinstance(schema, dict) else None
    if level == "light" or not isinstance(props, dict):
        return schema
    kind = lambda v: v["type"] if isinstance(v, dict) and isinstance(v.get("type"), str) else "any"
    return "(" + ", ".join(f"{k}: {kind(props[k])}" for k in sorted(props)) + ")"


def reduce_tool(tool, level: str) -> dict:
    tool, out = tool if isinstance(tool, dict) else {}, {}
    if "name" in tool:
        out["name"] = tool["name"]
    if isinstance(tool.get("description"), str):
        out["description"] = cut_bytes(tool["description"], LIMITS["tool_description"][level])
    if "input_schema" in tool:
        out["input_schema"] = reduce_schema(tool["input_schema"], level)
    if level != "aggressive" and "output_schema" in tool:
        out["output_schema"] = tool["output_schema"]
    return out


def namespace(name: str) -> str:
    return name.split("__", 1)[0] if "__" in name else "core"


def namespaces(name: Column) -> Column:
    """namespace of a column of names."""
    return F.when(F.contains(name, F.lit("__")), F.substring_index(name, "__", 1)).otherwise("core")


def reduce_tools(text: str, level: str) -> str:
    try:
        value = load_json(text)
    except (ValueError, RecursionError):
        return text
    if isinstance(value, dict):
        return dump(reduce_tool(value, level))
    if not isinstance(value, list):
        return text
    quota = LIMITS["tool_schemas"][level]
    if len(value) <= quota:
        return dump([reduce_tool(t, level) for t in value])
    name_of = lambda t: t["name"] if isinstance(t, dict) and isinstance(t.get("name"), str) else None
    spaces: dict[str, list] = {}
    for t in value:
        spaces.setdefault(namespace(name_of(t) or "unknown"), []).append(t)
    out: list[str] = []
    for ns in sorted(spaces):
        group = spaces[ns]
        full, rest = group[:quota], group[quota:]
        if not quota:
            out.append(f"[{ns}] {len(group)} tools: " + ", ".join(n for t in group if (n := name_of(t)) is not None))
            continue
        out += [dump(reduce_tool(t, level), pretty=False) for t in full]
        for t in rest:
            text_of = t.get("description") if isinstance(t, dict) else None
            out.append(f"  {name_of(t) or '?'}: {cut_bytes(text_of, 60) if isinstance(text_of, str) else ''}")
        quota -= len(full)
    return "\n".join(out)


# ---- code


def fold_decision(n: int, level: str) -> str:
    signature = LIMITS["signature_over"][level]
    return "signature" if signature is not None and n > signature else "summary" if n > LIMITS["summary_over"][level] else "full"


def fold_decisions(n: Column, level: str) -> Column:
    """fold_decision of a column of line counts."""
    out, signature = F.when(n > LIMITS["summary_over"][level], "summary").otherwise("full"), LIMITS["signature_over"][level]
    return out if signature is None else F.when(n > signature, "signature").otherwise(out)


_STRINGS = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'|`(?:\\.|[^`\\])*`", re.S)
_HEADERS = {
    "rust": re.compile(r"(?:\bpub(?:\([^)]*\))?\s+)?(?:\b(?:const|async|unsafe|extern\s+\"[^\"]*\")\s+)*\bfn\s+\w+"),
    "javascript": re.compile(r"(?<![\w$.])(?:async\s+)?function\s+[\w$]+"),
    "typescript": re.compile(r"(?<![\w$.])(?:async\s+)?function\s+[\w$]+"),
}
#: What stands before a function that is an expression, not a declaration.
_EXPRESSION = re.compile(r"(?:[=(,:?\[!&|+\-~<>%/*]|\b(?:return|typeof|new|void|yield|await|in|of|case|delete|throw))\s*\Z")


def _matching(plain: str, at: int) -> int:
    """The place behind the brace that closes the one at a place, or the text's end."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(plain, at):
        depth += 1 if m.group() == "{" else -1
        if not depth:
            return m.end()
    return len(plain)


def function_bodies(text: str, language: str) -> list[tuple[int, int]]:
    """(start, end) of outermost function bodies, by a scan that knows strings and comments, or Python's parser."""
    out: list[tuple[int, int]] = []
    if language == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return out
        rows = text.split("\n")
        starts = [0]
        for r in rows:
            starts.append(starts[-1] + len(r) + 1)
        place = lambda line, col: starts[line - 1] + len(rows[line - 1].encode()[:col].decode(errors="ignore"))
        todo = [tree]
        while todo:
            node = todo.pop()
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                first, last = node.body[0], node.body[-1]
                out.append((place(first.lineno, first.col_offset), place(last.end_lineno, last.end_col_offset)))
            else:
                todo += ast.iter_child_nodes(node)
        return sorted(out)
    head = _HEADERS.get(language)
    if head is None:
        return out
    plain = _STRINGS.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    at = 0
    while m := head.search(plain, at):
        at, depth = m.end(), 0
        if language != "rust" and _EXPRESSION.search(plain, max(0, m.start() - 200), m.start()):
            continue
        while at < len(plain) and (depth or plain[at] not in "{;"):
            depth += (plain[at] in "([") - (plain[at] in ")]")
            at += 1
            # braces of a type are no body
            if language == "typescript" and not depth and plain[at : at + 1] == "{" and plain[m.end() : at].rstrip()[-1:] in (":", "|", "&", "<", ","):
                at = _matching(plain, at)
        if at >= len(plain) or plain[at] == ";":
            continue
        start, at = at, _matching(plain, at)
        if plain[at - 1] == "}":
            out.append((start, at))
    return out


def fold_functions(text: str, language: str, level: str) -> str | None:
    """Long bodies folded in place; None if nothing folds."""
    out, done = [], 0
    for start, end in function_bodies(text, language):
        body = text[start:end]
        n = body.count("\n") + 1
        choice, new = fold_decision(n, level), None
        if choice == "signature":
            new = f"{{ /* ... {n} lines */ }}"
        elif choice == "summary" and len(rows := split_lines(body)) > 6:
            new = "\n".join([*rows[:3], f"    // ... {len(rows) - 5} lines folded ...", *rows[-2:]])
        if new is not None:
            out += [text[done:start], new]
            done = end
    return "".join([*out, text[done:]]) if out else None


# How import, type and function lines begin.
_IMPORT = {"rust": ("use ", "mod "), "python": ("import ", "from "), "go": ("import ",), "typescript": ("import ", "require("), "javascript": ("import ", "require("), "java": ("import ", "package "), "c": ("#include",), "cpp": ("#include",), "ruby": ("require ", "require_relative "), "php": ("use ", "require ", "include ")}
_TYPE = {"rust": ("struct ", "pub struct ", "enum ", "pub enum ", "trait ", "pub trait ", "type ", "pub type "), "typescript": ("interface ", "type ", "export interface ", "export type "), "python": ("class ",), "go": ("type ",)}
_TYPE["javascript"] = _TYPE["typescript"]
_FUNCTION = {"rust": ("pub fn ", "fn ", "pub async fn ", "async fn ", "pub(crate) fn "), "python": ("def ", "async def "), "go": ("func ",), "typescript": ("function ", "export function ", "async function ", "export async function ")}
_FUNCTION["javascript"] = _FUNCTION["typescript"]


def line_kind(line: str, language: str) -> str | None:
    """What a line begins: import, type, function or nothing."""
    tests = (("import", is_import), ("type", is_type), ("function", is_function))
    return next((name for name, test in tests if test(line, language)), None)


def line_kinds(line: Column, language: Column) -> Column:
    """line_kind of a column of lines."""

    @F.pandas_udf("string")
    def run(rows: pd.Series, languages: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else line_kind(r, g or "") for r, g in zip(rows, languages, strict=True)], dtype=object)

    return run(line, language)


def is_import(line: str, language: str) -> bool:
    s = line.strip()
    return s.startswith(_IMPORT.get(language, ())) or (language in ("typescript", "javascript") and s.startswith("const ") and "require(" in s)


def is_type(line: str, language: str) -> bool:
    s = line.strip()
    return s.startswith(_TYPE.get(language, ())) or (language == "java" and _has(s, "class ", "interface ", "enum ") and not s.startswith("//"))


def is_function(line: str, language: str) -> bool:
    s = line.strip()
    if language == "python":
        return s.startswith(_FUNCTION["python"]) and "(" in s
    if language in ("typescript", "javascript"):
        return not s.startswith("//") and (s.startswith(_FUNCTION["typescript"]) or ("(" in s and ") {" in s and not s.startswith(("if ", "for ", "while "))))
    if language == "java":
        return "(" in s and s.endswith("{") and _has(s, "public ", "private ", "protected ") and not s.startswith(("//", "if ", "for "))
    if language in ("c", "cpp"):
        return "(" in s and s.endswith("{") and not s.startswith(("#", "//", "if ", "for ", "while "))
    return s.startswith(_FUNCTION.get(language, ()))


def block_extent(rows: list[str], start: int, language: str) -> tuple[int, int]:
    """(first, last) row of a function's body: by indentation for Python, else by braces as they stand."""
    last = max(len(rows) - 1, 0)
    if language == "python":
        indent = lambda r: len(r.encode()) - len(r.lstrip().encode())
        stop = next((i for i in range(start + 1, len(rows)) if rows[i].strip() and indent(rows[i]) <= indent(rows[start])), None)
        return start + 1, last if stop is None else stop - 1
    depth, opened = 0, None
    for i in range(start, len(rows)):
        for c in re.findall("[{}]", rows[i]):
            if c == "{":
                opened = i if opened is None else opened
                depth += 1
            else:
                depth -= 1
                if not depth and opened is not None:
                    return opened, i
    return start if opened is None else opened, last


def fold_by_lines(text: str, language: str, level: str) -> str:
    rows = split_lines(text)
    if len(rows) <= LIMITS["file_lines"][level]:
        return text
    out, i = [], 0
    pick = lambda k, ok=True: [rows[k]] if ok and k < len(rows) else []
    while i < len(rows):
        first = last = i
        if not is_import(rows[i], language) and not is_type(rows[i], language) and is_function(rows[i], language):
            first, last = block_extent(rows, i, language)
        n = last - first
        if n <= 0:
            out.append(rows[i])
            i += 1
            continue
        choice = fold_decision(n, level)
        if choice == "full":
            out += rows[i : last + 1]
        elif choice == "signature":
            out.append(f"{rows[i].rstrip().rstrip('{').rstrip()} {{ /* ... {n} lines */ }}")
        else:
            a, z = first + 1, max(last - 1, 0)
            out += [rows[i], *pick(a), *pick(a + 1, a + 1 < z), *([f"    // ... {n} lines folded ..."] if n > 4 else []), *pick(z, z > a + 2), *pick(last)]
        i = last + 1
    return "\n".join(out)


def reduce_code(text: str, language: str, level: str) -> str:
    got = fold_functions(text, language, level)
    return fold_by_lines(text, language, level) if got is None else got


# ---- routing


def reduce_text(text: str | None, kind: str | None, level: str | None) -> str | None:
    if text is None:
        return None
    kind, level = kind or "unknown", level or "medium"
    if kind.startswith("code:"):
        return reduce_code(text, kind[5:], level)
    by_type = {"conversation": reduce_conversation, "json": reduce_json, "mcp_schema": reduce_tools}
    return by_type.get(kind, reduce_output)(text, level)


def reduce_all(text: str | None, kind: str) -> tuple[str | None, ...]:
    """The reduced text at every level; a JSON document is read once."""
    if text is None or kind != "json":
        return tuple(reduce_text(text, kind, v) for v in LEVELS)
    try:
        value = load_json(text)
        return tuple(dump(sample_json(value, 0, v)) for v in LEVELS)
    except (ValueError, RecursionError):
        return tuple(reduce_json(text, v) for v in LEVELS)


def reduced_levels(text: Column, kind: str) -> Column:
    """Struct of the reduced text at each level, for texts of one type, in one pass."""

    @F.pandas_udf(", ".join(f"{v} string" for v in LEVELS))
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([reduce_all(t, kind) for t in texts], columns=list(LEVELS), dtype=object)

    return run(text)


def reduced(text: Column, kind: Column, level: Column) -> Column:
    """The reduced text: every type in one Arrow pass over its rows."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, kinds: pd.Series, level_names: pd.Series) -> pd.Series:
        return pd.Series([reduce_text(t, k, v) for t, k, v in zip(texts, kinds, level_names, strict=True)], dtype=object)

    return run(text, kind, level)
