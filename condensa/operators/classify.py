"""Content type and language of a text, as ordered native tests."""

from __future__ import annotations

import functools
import json
import operator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from condensa.functions import levels as L
from condensa.functions.text import first_lines, shorter_trimmed


def _any(tests: list[Column]) -> Column:
    return functools.reduce(operator.or_, tests)


def has_ansi(text: Column) -> Column:
    return F.contains(text, F.lit("\x1b["))


def looks_like_command(text: Column) -> Column:
    return F.exists(first_lines(text, 5), lambda x: _any([F.contains(x, F.lit(m)) for m in L.COMMAND_MARKS]))


def opens_turn(line: Column) -> Column:
    return _any([F.startswith(line, F.lit(r)) for r in L.ROLES])


def looks_like_chat(text: Column) -> Column:
    return F.size(F.filter(first_lines(text, 20), opens_turn)) >= 2


def language_of(text: Column) -> Column:
    """Language by shebang, then by keywords in a fixed order; null if none fits."""
    has = lambda *words: _any([F.contains(text, F.lit(w)) for w in words])
    first = F.element_at(first_lines(text, 1), 1)
    bang = lambda *words: F.startswith(first, F.lit("#!")) & _any([F.contains(first, F.lit(w)) for w in words])
    rules = [
        ("python", bang("python")),
        ("javascript", bang("node", "deno", "bun")),
        ("bash", bang("bash", "sh", "zsh")),
        ("ruby", bang("ruby")),
        ("php", bang("php")),
        ("rust", has("fn main()", "pub fn ", "impl ")),
        ("go", has("func ") & has("package ")),
        ("python", has("def ") & has("import ") & ~has("{")),
        ("typescript", has("interface ") & has(": ") & has("export ")),
        ("javascript", has("function ", "const ", "=> {")),
        ("java", has("public class ", "public static void main")),
    ]
    out = F.when(rules[0][1], F.lit(rules[0][0]))
    for name, test in rules[1:]:
        out = out.when(test, F.lit(name))
    return out


def language_of_path(path: Column) -> Column:
    ends = {e: name for name, es in L.EXTENSIONS.items() for e in es}
    table = F.create_map(*(F.lit(x) for kv in ends.items() for x in kv))
    return F.try_element_at(table, F.lower(F.substring_index(path, ".", -1)))


def json_kind(text: str | None) -> str | None:
    """mcp_schema, json, or None if the text is no JSON document."""
    def no(_):
        raise ValueError

    try:
        value = json.loads((text or "").strip(), parse_constant=no)
    except (ValueError, RecursionError):
        return None
    tool = lambda v: isinstance(v, dict) and "name" in v and "input_schema" in v
    return "mcp_schema" if tool(value) or (isinstance(value, list) and any(map(tool, value))) else "json"


def _json_kind(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json_kind(t) if t else None)

    # only texts that open with a brace or bracket are sent to Python
    return run(F.when(text.rlike(r"(?U)^\s*[\[{]"), text))


def content_type(text: Column, maybe_json: bool = True) -> Column:
    """Display form; maybe_json=False leaves out the only test that is not native.  Each test stands once, in order."""
    rules = [
        F.when(shorter_trimmed(text, 10), "unknown"),
        *([_json_kind(text)] if maybe_json else []),
        F.when(has_ansi(text) | looks_like_command(text), "command_output"),
        F.concat(F.lit("code:"), language_of(text)),
        F.when(looks_like_chat(text), "conversation"),
    ]
    return F.coalesce(*rules, F.lit("unknown"))


def type_of_tool(tool: Column, text: Column, maybe_json: bool = True) -> Column:
    return F.when(tool.isin("Bash", "Grep", "Glob"), "command_output").when(tool.isin("Edit", "Write"), "code:rust").otherwise(content_type(text, maybe_json))
