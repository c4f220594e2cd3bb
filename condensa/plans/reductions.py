"""Queries that prove the reducers at every level, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from condensa.functions import levels as L
from condensa.functions import text as T
from condensa.operators import classify, diffs, reducers
from condensa.plans.registry import docs, query, spread, table, values
from condensa.sources import store as S

NL = "chr(10)"


def any_of(column: str, marks: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{m}')" for m in marks) + ")"


def sql_lines(source: str, key: str, text: str) -> str:
    """(key, i, line): lines from 1, one \\r before a line end dropped, no empty line after a final line end."""
    return f"""SELECT {key}, i, CASE WHEN i < n THEN regexp_replace(line, '\\r$', '') ELSE line END AS line FROM (
 SELECT {key}, unnest(string_split({text}, {NL})) AS line, generate_subscripts(string_split({text}, {NL}), 1) AS i, len(string_split({text}, {NL})) AS n FROM {source}) WHERE i < n OR line <> ''"""


# ---- conversations

_CHAT = f"""msg AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'User: ' WHEN 'assistant' THEN 'Assistant: ' ELSE '' END || text AS line FROM conversations),
 doc AS (SELECT conv_id, string_agg(line, {NL} ORDER BY turn, line) AS content FROM msg GROUP BY 1),
 l AS ({sql_lines('doc', 'conv_id', 'content')}),
 o AS (SELECT *, CASE WHEN {' OR '.join(f"starts_with(line, '{r}')" for r in L.ROLES)} THEN 1 ELSE 0 END AS opens FROM l),
 p AS (SELECT *, sum(opens) OVER (PARTITION BY conv_id ORDER BY i) AS t FROM o),
 q AS (SELECT *, row_number() OVER (PARTITION BY conv_id, t ORDER BY i) - 1 AS j, sum(CASE WHEN contains(line, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, t ORDER BY i) AS fences FROM p),
 k AS (SELECT *, contains(line, '```') OR fences % 2 = 1 OR {any_of('line', ['error', 'fix', '/'])} OR starts_with(line, '- ') OR starts_with(line, '* ') OR starts_with(line, '#') AS stays FROM q),
 u AS (SELECT conv_id, t, string_agg(line, {NL} ORDER BY i) AS raw, count(*) AS n, arg_min(line, i) AS first, max(opens) AS named,
  {', '.join(f"list(line ORDER BY i) FILTER (stays OR j < {L.LIMITS['turn_lines'][v]}) AS kept_{v}" for v in L.LEVELS)} FROM k GROUP BY 1, 2),
 x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY t) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS total FROM u),
 y AS (SELECT *, least(1.0::DOUBLE, pos::DOUBLE / total * 0.3::DOUBLE + CASE WHEN contains(raw, '```') THEN 0.3::DOUBLE ELSE 0 END
  + CASE WHEN {any_of('raw', ['.rs', '.ts', '.py', '.js', '/src/', chr(92) + 'src' + chr(92)])} THEN 0.15::DOUBLE ELSE 0 END
  + CASE WHEN {any_of('raw', ["I''ll ", "Let''s ", 'We should', 'The fix is', "I''ve decided", 'Going with'])} THEN 0.2::DOUBLE ELSE 0 END
  + CASE WHEN {any_of('raw', ['error', 'Error', 'failed', 'FAILED', 'panic'])} THEN 0.25::DOUBLE ELSE 0 END) AS score,
  CASE WHEN strlen(first) <= 100 THEN first ELSE left(first, list_max(list_filter(range(1, 101), lambda c: strlen(left(first, c)) <= 100))) || '...' END AS head FROM x)"""


def _turn_form(v: str) -> str:
    m = {k: L.LIMITS[k][v] for k in ("recent_turns", "turn_score", "turn_lines")}
    return f"""CASE WHEN pos = 0 OR pos >= total - {m['recent_turns']} THEN raw
  WHEN score >= {m['turn_score']} THEN CASE WHEN n <= {m['turn_lines']} OR len(kept_{v}) >= n THEN raw ELSE array_to_string(kept_{v}, {NL}) || {NL} || '[... trimmed]' END
  ELSE '[' || CASE WHEN named = 1 THEN string_split(first, ':')[1] ELSE '' END || ' — ' || n || ' lines] ' || head END"""


@query(f"""WITH {_CHAT} SELECT y.conv_id, {', '.join(f"CASE WHEN max(total) <= 4 THEN any_value(content) ELSE string_agg({_turn_form(v)}, {NL} || {NL} ORDER BY pos) END AS {v}" for v in L.LEVELS)}
 FROM y JOIN doc USING (conv_id) GROUP BY y.conv_id""")
def conversation_reduce(spark, d):
    name = F.when(F.col("role") == "user", "User: ").when(F.col("role") == "assistant", "Assistant: ").otherwise("")
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(name, "text").alias("line")))).alias("x"))
    return rows.select("conv_id", reducers.reduced_levels(F.array_join(F.transform("x", lambda e: e["line"]), "\n"), "conversation").alias("r")).select("conv_id", "r.*")


@query(f"""WITH {_CHAT} SELECT conv_id, t::BIGINT AS t, CASE WHEN named = 1 THEN string_split(first, ':')[1] ELSE '' END AS role, n, score FROM y""")
def conversation_turns(spark, d):
    """Turns of the conversations by the table function, with their roles and scores."""
    from condensa.functions.sql import register

    register(spark)
    name = F.when(F.col("role") == "user", "User: ").when(F.col("role") == "assistant", "Assistant: ").otherwise("")
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(name, "text").alias("line")))).alias("x"))
    rows.select("conv_id", F.array_join(F.transform("x", lambda e: e["line"]), "\n").alias("content")).createOrReplaceTempView("condensa_chats")
    turns = spark.sql("SELECT c.conv_id, t.* FROM condensa_chats c, LATERAL text_turns(c.content) t")
    # the table function numbers turns from 0, the SQL by the roles met, so that lines before the first role are turn 0
    first = F.when(F.min(F.when(F.col("place") == 0, F.col("role"))).over(_conversation()) == "", 0).otherwise(1)
    total = F.count("*").over(_conversation())
    return turns.select("conv_id", (F.col("place") + first).cast("long").alias("t"), "role", F.col("n").cast("long").alias("n"), reducers.scored_turn(F.col("raw"), F.col("place"), total).alias("score"))


def _conversation():
    from pyspark.sql import Window

    return Window.partitionBy("conv_id")


# ---- JSON and tools


def _item(v: str) -> str:
    if v == "aggressive":
        return "'    \"{flags, l_linenumber, l_quantity}\"'"
    flags = "'\"{dates, l_returnflag}\"'" if v == "medium" else f"""'{{' || {NL} || '        "dates": {{' || {NL} || '          "l_shipdate": "' || strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S.%g') || '"' || {NL} || '        }},' || {NL} || '        "l_returnflag": "' || l_returnflag || '"' || {NL} || '      }}'"""
    return f"""'    {{' || {NL} || '      "flags": ' || {flags} || ',' || {NL} || '      "l_linenumber": ' || l_linenumber || ',' || {NL} || '      "l_quantity": ' || l_quantity || {NL} || '    }}'"""


def _items(v: str) -> str:
    most = L.LIMITS["json_items"][v]
    head = max(most // 2, 1)
    marker = f"""'    "... ' || (n - {most}) || ' more items (' || n || ' total)"'"""
    return f"CASE WHEN n <= {most} THEN i_{v} ELSE list_concat(i_{v}[1:{head}], [{marker}], i_{v}[-{most - head}:]) END"


@query(f"""WITH i AS (SELECT l_orderkey, count(*) AS n, {', '.join(f"list({_item(v)} ORDER BY l_linenumber, l_quantity, l_returnflag, l_shipdate) AS i_{v}" for v in L.LEVELS)} FROM lineitem GROUP BY 1)
 SELECT o_orderkey, {', '.join(f'''concat('{{', {NL}, '  "items": [', {NL}, array_to_string({_items(v)}, ',' || {NL}), {NL}, '  ],', {NL}, '  "o_orderkey": ', o_orderkey, ',', {NL}, '  "o_totalprice": ', o_totalprice, {NL}, '}}') AS {v}''' for v in L.LEVELS)}
 FROM orders JOIN i ON l_orderkey = o_orderkey""")
def json_reduce(spark, d):
    items = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", F.struct("l_returnflag", F.struct("l_shipdate").alias("dates")).alias("flags")))).alias("items"))
    o = table(spark, d, "orders").join(items, "o_orderkey")
    return o.select("o_orderkey", reducers.reduced_levels(F.to_json(F.struct("o_orderkey", "o_totalprice", "items")), "json").alias("r")).select("o_orderkey", "r.*")


_DEEP = [
    ('{"a":{"b":{"c":1}}}', "aggressive", '{\n  "a": {\n    "b": "{c}"\n  }\n}'),
    ('{"a":{"b":{"k1":1,"k2":2,"k3":3,"k4":4,"k5":5,"k6":6}}}', "aggressive", '{\n  "a": {\n    "b": "{...6 keys: k1, k2, k3, k4, k5, ...}"\n  }\n}'),
    ('{"a":', "aggressive", '{"a":'),
    ("[0,1,2,3,4,5]", "medium", '[\n  0,\n  1,\n  "... 1 more items (6 total)",\n  3,\n  4,\n  5\n]'),
    ('{"a":{"b":{"c":{"d":{"e":{"f":1}}}}}}', "light", '{\n  "a": {\n    "b": {\n      "c": {\n        "d": {\n          "e": "{f}"\n        }\n      }\n    }\n  }\n}'),
    ('"text"', "light", '"text"'),
    ("null", "medium", "null"),
]


@query(values(_DEEP, "content, level, reduced"))
def json_deep(spark, d):
    rows = spark.createDataFrame([r[:2] for r in _DEEP], "content string, level string")
    return rows.select("content", "level", reducers.reduced(F.col("content"), F.lit("json"), F.col("level")).alias("reduced"))


def _schema(v: str, pretty: bool) -> str:
    if v == "aggressive":
        return '"(p_size: integer)"'
    told = '"description":"size",' if v == "light" else ""
    if not pretty:
        return '{"properties":{"p_size":{' + told + '"type":"integer"}}}'
    told = '          "description": "size",\n' if v == "light" else ""
    return '{\n      "properties": {\n        "p_size": {\n' + told + '          "type": "integer"\n        }\n      }\n    }'


def _tools(v: str) -> str:
    quota = L.LIMITS["tool_schemas"][v]
    compact = f"""'{{"description":"' || p_name || '","input_schema":' || '{_schema(v, False)}' || ',"name":"' || name || '"}}'"""
    wide = f"""'  {{' || {NL} || '    "description": "' || p_name || '",' || {NL} || '    "input_schema": ' || '{_schema(v, True)}' || ',' || {NL} || '    "name": "' || name || '"' || {NL} || '  }}'"""
    short = f"SELECT p_brand, '[' || {NL} || string_agg({wide}, ',' || {NL} ORDER BY p_partkey) || {NL} || ']' AS out FROM r WHERE total <= {quota} GROUP BY 1"
    rows = f"SELECT p_brand, pos, CASE WHEN pos <= {quota} THEN {compact} ELSE '  ' || name || ': ' || p_name END AS line FROM r WHERE total > {quota} AND before < {quota}"
    rest = f"SELECT p_brand, min(pos) AS pos, '[' || ns || '] ' || count(*) || ' tools: ' || string_agg(name, ', ' ORDER BY pos) AS line FROM r WHERE total > {quota} AND before >= {quota} GROUP BY p_brand, ns"
    return f"{short} UNION ALL SELECT p_brand, string_agg(line, {NL} ORDER BY pos) AS out FROM ({rows} UNION ALL {rest}) GROUP BY 1"


@query(f"""WITH t AS (SELECT p_brand, p_partkey, p_name, replace(lower(p_type), ' ', '_') AS ns, replace(lower(p_type), ' ', '_') || '__' || p_partkey AS name FROM part),
 r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY ns, p_partkey) AS pos, rank() OVER (PARTITION BY p_brand ORDER BY ns) - 1 AS before, count(*) OVER (PARTITION BY p_brand) AS total FROM t)
 SELECT a.p_brand, a.out AS light, b.out AS medium, c.out AS aggressive FROM ({_tools('light')}) a JOIN ({_tools('medium')}) b USING (p_brand) JOIN ({_tools('aggressive')}) c USING (p_brand)""")
def tool_list_reduce(spark, d):
    schema = F.struct(F.struct(F.struct(F.lit("integer").alias("type"), F.lit("size").alias("description")).alias("p_size")).alias("properties"))
    tool = F.struct("p_partkey", F.struct(F.concat(F.lower(F.regexp_replace("p_type", " ", "_")), F.lit("__"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_name").alias("description"), schema.alias("input_schema")).alias("t"))
    rows = table(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(tool)).alias("x"))
    return rows.select("p_brand", reducers.reduced_levels(F.to_json(F.transform("x", lambda e: e["t"])), "mcp_schema").alias("r")).select("p_brand", "r.*")


_TOOL = '{"name":"t","description":"%s","input_schema":{"properties":{"p":{"type":"string","description":"x"},"q":{}}},"output_schema":{"a":1},"extra":2}' % ("d" * 90)
_TOOLS = [
    (_TOOL, "aggressive", '{\n  "description": "' + "d" * 80 + '...",\n  "input_schema": "(p: string, q: any)",\n  "name": "t"\n}'),
    (_TOOL, "medium", '{\n  "description": "' + "d" * 90 + '",\n  "input_schema": {\n    "properties": {\n      "p": {\n        "type": "string"\n      },\n      "q": {}\n    }\n  },\n  "name": "t",\n  "output_schema": {\n    "a": 1\n  }\n}'),
    ('{"name":"n"}', "light", '{\n  "name": "n"\n}'),
    ("[1", "light", "[1"),
    ('"s"', "light", '"s"'),
]


@query(values(_TOOLS, "content, level, reduced"))
def tool_reduce(spark, d):
    rows = spark.createDataFrame([r[:2] for r in _TOOLS], "content string, level string")
    return rows.select("content", "level", reducers.reduced(F.col("content"), F.lit("mcp_schema"), F.col("level")).alias("reduced"))


# ---- command output


def sql_reduced_output(source: str, key: str, text: str, level: str) -> str:
    """Named tables that end in reduced_{level} (key, reduced): runs of alike lines collapsed, the rest cut; no summary is asked for."""
    most, alike = L.LIMITS["output_lines"][level], L.LIMITS["output_similarity"][level]
    zipped = "list_zip(string_split(head, ''), string_split(l.line, ''))"
    same = f"len(list_filter({zipped}, lambda p: p[1] = p[2]))::DOUBLE / greatest(strlen(head), strlen(l.line))"
    near = f"(CASE WHEN r.head = '' OR l.line = '' THEN FALSE WHEN r.head = l.line THEN TRUE WHEN least(length(r.head), length(l.line)) < {alike} * greatest(length(r.head), length(l.line)) THEN FALSE ELSE {same} >= {alike} END)"
    s = f"_{level}"
    return f"""l{s} AS MATERIALIZED (SELECT {key}, i, regexp_replace(line, '\\s+$', '') AS line FROM ({sql_lines(source, key, text)})),
 r{s} AS (SELECT {key}, i, line AS head, 1 AS run FROM l{s} WHERE i = 1
  UNION ALL SELECT r.{key}, l.i, CASE WHEN {near} THEN r.head ELSE l.line END, CASE WHEN {near} THEN r.run ELSE r.run + 1 END FROM r{s} r JOIN l{s} l ON l.{key} = r.{key} AND l.i = r.i + 1),
 g{s} AS (SELECT {key}, run, any_value(head) AS head, count(*) AS n FROM r{s} GROUP BY 1, 2),
 o{s} AS (SELECT {key}, flatten(list(CASE WHEN n = 1 THEN [head] WHEN n = 2 THEN [head, head] ELSE [head, '[... ' || n || ' similar lines]'] END ORDER BY run)) AS rows FROM g{s} GROUP BY 1),
 reduced{s} AS (SELECT {key}, CASE WHEN len(rows) <= {most} THEN array_to_string(rows, {NL}) ELSE array_to_string(rows[1:{most}], {NL}) || {NL} || '[... ' || (len(rows) - {most}) || ' more lines truncated]' END AS reduced FROM o{s})"""


_ITEM_LOG = f"SELECT user_id, string_agg(CASE WHEN event_id % 11 = 0 THEN '' ELSE event_type || ' at item ' || (event_id % 13) || ' of ' || (event_id % 3) END, {NL} ORDER BY ts, event_id) AS content FROM events GROUP BY user_id"


@query(f"""WITH RECURSIVE logs AS ({_ITEM_LOG}), {sql_reduced_output('logs', 'user_id', 'content', 'light')}, {sql_reduced_output('logs', 'user_id', 'content', 'medium')}, {sql_reduced_output('logs', 'user_id', 'content', 'aggressive')}
 SELECT a.user_id, a.reduced AS light, b.reduced AS medium, c.reduced AS aggressive FROM reduced_light a JOIN reduced_medium b USING (user_id) JOIN reduced_aggressive c USING (user_id)""")
def reduce_logs(spark, d):
    line = F.when(F.col("event_id") % 11 == 0, "").otherwise(F.concat("event_type", F.lit(" at item "), (F.col("event_id") % 13).cast("string"), F.lit(" of "), (F.col("event_id") % 3).cast("string")))
    rows = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", line.alias("line")))).alias("x"))
    return rows.select("user_id", reducers.reduced_levels(F.array_join(F.transform("x", lambda e: e["line"]), "\n"), "command_output").alias("r")).select("user_id", "r.*")


_TESTS = f"SELECT user_id, string_agg('test m::e' || event_id || CASE WHEN event_id % 7 = 0 THEN ' ... ignored' ELSE ' ... ok' END, {NL} ORDER BY event_id) AS content, count(*) AS n, count(*) FILTER (event_id % 7 = 0) AS skipped FROM events GROUP BY user_id"


@query(f"""WITH RECURSIVE logs AS ({_TESTS}), {sql_reduced_output('logs', 'user_id', 'content', 'medium')}
 SELECT user_id, CASE WHEN n < 5 THEN reduced ELSE '[Test Summary] ' || (n - skipped) || ' passed, 0 failed, ' || skipped || ' skipped (' || n || ' total)' END AS reduced FROM logs JOIN reduced_medium USING (user_id)""")
def test_log_summary(spark, d):
    """Test logs of every length: summed up from five lines on."""
    line = F.concat(F.lit("test m::e"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 7 == 0, " ... ignored").otherwise(" ... ok"))
    rows = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))).alias("x"))
    return rows.select("user_id", reducers.reduced(F.array_join(F.transform("x", lambda e: e["line"]), "\n"), F.lit("command_output"), F.lit("medium")).alias("reduced"))


@query(f"""WITH RECURSIVE logs AS (SELECT l_orderkey, string_agg('error[E' || l_linenumber || ']: bad ' || l_returnflag, {NL} ORDER BY l_linenumber, l_returnflag) AS content, count(*) AS n,
  list_sort(list_distinct(list('error[E' || l_linenumber || ']: bad ' || l_returnflag))) AS rows FROM lineitem GROUP BY 1), {sql_reduced_output('logs', 'l_orderkey', 'content', 'aggressive')}
 SELECT l_orderkey, CASE WHEN n < 3 THEN reduced ELSE '[Compiler Summary] ' || n || ' errors, 0 warnings' || {NL} || {NL} || 'Errors:' || {NL} || array_to_string(list_transform(logs.rows[1:5], lambda x: '  ' || x), {NL})
  || CASE WHEN n > len(logs.rows[1:5]) THEN {NL} || '  [... ' || (n - len(logs.rows[1:5])) || ' more errors]' ELSE '' END END AS reduced FROM logs JOIN reduced_aggressive USING (l_orderkey)""")
def compiler_log_summary(spark, d):
    """Compiler logs of every length: summed up from three errors on."""
    line = F.concat(F.lit("error[E"), F.col("l_linenumber").cast("string"), F.lit("]: bad "), "l_returnflag")
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("line")))).alias("x"))
    return rows.select("l_orderkey", reducers.reduced(F.array_join(F.transform("x", lambda e: e["line"]), "\n"), F.lit("command_output"), F.lit("aggressive")).alias("reduced"))


_FAILED = "event_id % 5 = 0"
_RESULT = "'test result: FAILED. ' || count(*) || ' run; finished'"
_CASES = f"""SELECT user_id, string_agg('test m::e' || event_id || CASE WHEN {_FAILED} THEN ' ... FAILED' || {NL} || 'boom in ' || event_type || {NL} WHEN event_id % 7 = 0 THEN ' ... skipped' ELSE ' ... ok' END, {NL} ORDER BY event_id) AS content,
 list('test m::e' || event_id || ' ... FAILED' ORDER BY event_id) FILTER ({_FAILED}) AS failed, list('boom in ' || event_type ORDER BY event_id) FILTER ({_FAILED}) AS boom,
 count(*) FILTER ({_FAILED}) AS f, count(*) FILTER (NOT {_FAILED} AND event_id % 7 = 0) AS s, count(*) FILTER (NOT {_FAILED} AND event_id % 7 <> 0) AS p, count(*) AS n FROM events GROUP BY user_id HAVING count(*) >= 5"""


@query(f"""WITH t AS ({_CASES}), b AS (SELECT *, coalesce(flatten(list_transform(range(1, f + 1), lambda k: CASE WHEN k <= 7 THEN [failed[k], boom[k], ''] ELSE [failed[k], boom[k]] END)), []) AS rows FROM t)
 SELECT user_id, {', '.join(f"'[Test Summary] ' || p || ' passed, ' || f || ' failed, ' || s || ' skipped (' || (p + f + s) || ' total)' || CASE WHEN f > 0 THEN {NL} || {NL} || 'Failures:' || {NL} || array_to_string(list_transform(rows[1:{L.LIMITS['test_failures'][v]}], lambda x: '  ' || x), {NL}) || CASE WHEN len(rows) > {L.LIMITS['test_failures'][v]} THEN {NL} || '  [... ' || (len(rows) - {L.LIMITS['test_failures'][v]}) || ' more failure lines]' ELSE '' END ELSE '' END || {NL} || 'Tests: done' AS {v}" for v in L.LEVELS)} FROM b""")
def test_log_failures(spark, d):
    """Failing tests: each one's lines up to the next blank line are kept; beyond 20 such lines, one line each."""
    failed = F.concat(F.lit(" ... FAILED\nboom in "), "event_type", F.lit("\n"))
    line = F.concat(F.lit("test m::e"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 5 == 0, failed).when(F.col("event_id") % 7 == 0, " ... skipped").otherwise(" ... ok"))
    rows = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))).alias("x")).where("n >= 5")
    text = F.concat(F.array_join(F.transform("x", lambda e: e["line"]), "\n"), F.lit("\nTests: done"))
    return rows.select("user_id", reducers.reduced_levels(text, "command_output").alias("r")).select("user_id", "r.*")


_MEASURED = f"""plain AS (SELECT doc_id, regexp_replace(text, '\\x1b\\[[0-9;]*[A-Za-z]', '', 'g') AS plain FROM documents),
 {sql_reduced_output('plain', 'doc_id', 'plain', 'medium')}"""


def _measured_columns() -> str:
    tokens = "ceil(strlen({}) / 3.5)::BIGINT"
    o, c = tokens.format("d.text"), tokens.format("coalesce(m.reduced, '')")
    return f"d.doc_id AS id, d.source AS session_id, sha256(d.text) AS original_hash, {o} AS original_tokens, {c} AS compressed_tokens, CASE WHEN {o} > 0 THEN 1 - {c}::DOUBLE / {o}::DOUBLE ELSE 0.0 END AS ratio"


@query(f"WITH RECURSIVE {_MEASURED} SELECT {_measured_columns()} FROM documents d LEFT JOIN reduced_medium m USING (doc_id)")
def reduce_documents(spark, d):
    """The whole pipeline: classify, reduce, measure (the given documents are of the types that the output reducer takes)."""
    rows = spread(docs(spark, d).select(F.col("doc_id").alias("id"), F.col("source").alias("session_id"), F.col("text").alias("content")))
    return S.measure(rows, "medium").select("id", "session_id", "original_hash", "original_tokens", "compressed_tokens", "ratio")


# ---- types


_KINDS = ['{"name":"x","input_schema":{"a":1}}', '[1,{"name":"x","input_schema":null}]', '{"a":[1,2,%]}', "[1,2,3,4,%]", "{broken json %", '  {"padding":%}  ']


@query("SELECT p_partkey, ['mcp_schema', 'mcp_schema', 'json', 'json', 'unknown', 'json'][p_partkey % 6 + 1] AS content_type FROM part")
def json_types(spark, d):
    """Texts that are JSON documents, tool schemas, or neither."""
    text = F.replace(F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("p_partkey") % 6 + 1).cast("int")), F.lit("%"), F.col("p_partkey").cast("string"))
    return table(spark, d, "part").select("p_partkey", classify.content_type(text).alias("content_type"))


_BANGS = [
    ("#!/usr/bin/env python3\nx", "python"), ("#!/usr/bin/node\nx", "javascript"), ("#!/bin/zsh\nx", "bash"), ("#!/usr/bin/ruby\nx", "ruby"), ("#!/usr/bin/php\nx", "php"), ("#!/usr/bin/perl\nconst x", "javascript"),
    ("fn main() {}", "rust"), ("package a\nfunc b", "go"), ("import a\ndef b(): pass", "python"), ("import a\ndef b(): {}", None), ("export interface A { b: C }", "typescript"), ("public class A", "java"), ("plain", None),
]


@query(values(_BANGS, "content, language"))
def language_rules(spark, d):
    """Each rule of the language test once, in order."""
    return spark.createDataFrame([r[:1] for r in _BANGS], "content string").select("content", classify.language_of(F.col("content")).alias("language"))


_NAMES = [
    ("type", "code", "code:rust"), ("type", "Output", "command_output"), ("type", "mcp", "mcp_schema"), ("type", "conversation", "conversation"), ("type", "zap", None), ("type", "unknown", None),
    ("language", "rs", "rust"), ("language", "C++", "cpp"), ("language", "Python", "python"), ("language", "tsx", "typescript"), ("language", "swift", "swift"), ("language", "kotlin", None), ("language", "zap", None),
    ("level", "l", "light"), ("level", "M", "medium"), ("level", "aggressive", "aggressive"), ("level", "zap", None),
    ("service type", "code", "code:rust"), ("service type", "zap", "unknown"), ("service level", "light", "light"), ("service level", "zap", "medium"),
]


@query(values(_NAMES, "what, name, parsed"))
def parse_names(spark, d):
    """Names of types, languages and levels; what is refused is null."""
    parsers = {"type": L.parse_type, "language": L.parse_language, "level": L.parse_level, "service type": L.service_type, "service level": L.service_level}

    @F.udf("string")
    def parse(what, name):
        try:
            return parsers[what](name)
        except ValueError:
            return None

    return spark.createDataFrame([r[:2] for r in _NAMES], "what string, name string").select("what", "name", parse("what", "name").alias("parsed"))


# ---- code

_N = "(s_suppkey % 40)"


def _folded(head: str, row: str, tail: str, n: str, first: str, last: str) -> str:
    """SQL of a function in braces at level aggressive; n lines of body, first and last the shown ones."""
    return f"""CASE WHEN {n} > 10 THEN {head} || '{{ /* ... ' || {n} || ' lines */ }}' WHEN {n} > 6 THEN {head} || {first} || '    // ... ' || ({n} - 5) || ' lines folded ...' || {NL} || {last} ELSE {head} || '{{' || {NL} || repeat({row}, {_N}::INT) || '}}' END || {tail}"""


_BRACE_ROW = f"'  a();' || {NL}"
_PY_BODY = f"'a()' || repeat({NL} || '    a()', {_N}::INT - 1)"
_PY_FOLDED = f"""CASE WHEN {_N} > 10 THEN '{{ /* ... ' || {_N} || ' lines */ }}' WHEN {_N} > 6 THEN 'a()' || repeat({NL} || '    a()', 2) || {NL} || '    // ... ' || ({_N} - 5) || ' lines folded ...' || repeat({NL} || '    a()', 2) ELSE {_PY_BODY} END"""


def _braced(head: str) -> str:
    shown = f"'{{' || {NL} || repeat({_BRACE_ROW}, 2)"
    return _folded(f"{head} || ' '", _BRACE_ROW, NL, f"({_N} + 2)", shown, f"{_BRACE_ROW} || '}}'")


@query(f"""SELECT s_suppkey, {_braced("'function f' || s_suppkey || '()'")} AS javascript, {_braced("'export async function f' || s_suppkey || '(x: {a: number}): void'").replace("(x: {a: number}): void", "(x: number): void")} AS typescript,
 CASE WHEN {_N} = 0 THEN 'class C:' || {NL} || '  def f(self):' || {NL} ELSE 'class C:' || {NL} || '  def f(self):' || {NL} || '    ' || {_PY_FOLDED} || {NL} END AS python FROM supplier""")
def code_fold_languages(spark, d):
    """Functions of JavaScript, TypeScript and methods of Python, folded by their bodies."""
    n = (F.col("s_suppkey") % 40).cast("int")
    key, rows = F.col("s_suppkey").cast("string"), F.repeat(F.lit("  a();\n"), n)
    js = F.concat(F.lit("function f"), key, F.lit("() {\n"), rows, F.lit("}\n"))
    ts = F.concat(F.lit("export async function f"), key, F.lit("(x: number): void {\n"), rows, F.lit("}\n"))
    py = F.concat(F.lit("class C:\n  def f(self):\n"), F.repeat(F.lit("    a()\n"), n))
    folded = lambda text, language: reducers.reduced(text, F.lit(f"code:{language}"), F.lit("aggressive")).alias(language)
    return table(spark, d, "supplier").select("s_suppkey", folded(js, "javascript"), folded(ts, "typescript"), folded(py, "python"))


_HEADS = {"go": "func f() {", "java": "public void f() {", "c": "void f() {"}


def _by_lines(language: str) -> str:
    """SQL of four functions in one file, folded by their lines at level aggressive."""
    head, n = _HEADS[language], f"({_N} + 1)"
    full = f"'{head}' || {NL} || repeat('    a()' || {NL}, {_N}::INT) || '}}'"
    summary = f"'{head}' || {NL} || repeat('    a()' || {NL}, 2) || '    // ... ' || {n} || ' lines folded ...' || {NL} || CASE WHEN {_N} > 3 THEN '    a()' || {NL} ELSE '' END || '}}'"
    one = f"CASE WHEN 4 * ({_N} + 2) <= 20 THEN {full} WHEN {n} > 10 THEN '{head.rstrip(' {')}' || ' {{ /* ... ' || {n} || ' lines */ }}' WHEN {n} > 5 THEN {summary} ELSE {full} END"
    block = f"({one})".replace("{{ /*", "{ /*").replace("*/ }}", "*/ }")
    return f"CASE WHEN 4 * ({_N} + 2) <= 20 THEN repeat({block} || {NL}, 4) ELSE repeat({block} || {NL}, 3) || {block} END AS {language}"


@query(f"SELECT s_suppkey, {', '.join(map(_by_lines, _HEADS))} FROM supplier")
def code_fold_by_lines(spark, d):
    """Languages without a scanner of their own: functions found and folded line by line."""
    rows = F.repeat(F.lit("    a()\n"), (F.col("s_suppkey") % 40).cast("int"))
    text = {k: F.repeat(F.concat(F.lit(h + "\n"), rows, F.lit("}\n")), 4) for k, h in _HEADS.items()}
    return table(spark, d, "supplier").select("s_suppkey", *(reducers.reduced(t, F.lit(f"code:{k}"), F.lit("aggressive")).alias(k) for k, t in text.items()))


_LINES = [
    ("use std::fmt;", "rust", "import"), ("  mod a;", "rust", "import"), ("pub struct A {", "rust", "type"), ("enum A {", "rust", "type"), ("pub(crate) fn a() {", "rust", "function"), ("async fn a() {", "rust", "function"), ("let a = 1;", "rust", None),
    ("import os", "python", "import"), ("from a import b", "python", "import"), ("class A:", "python", "type"), ("async def a():", "python", "function"), ("def a", "python", None),
    ("const a = require('b')", "javascript", "import"), ("export type A = B", "typescript", "type"), ("export function a() {", "typescript", "function"), ("a(b) {", "javascript", "function"), ("if (a) {", "javascript", None), ("// a(b) {", "javascript", None),
    ("import a.b;", "java", "import"), ("public class A {", "java", "type"), ("private int a() {", "java", "function"), ("int a() {", "java", None),
    ("#include <a.h>", "c", "import"), ("int a() {", "c", "function"), ("if (a) {", "cpp", None), ("func a() {", "go", "function"), ("type A struct {", "go", "type"), ("require 'a'", "ruby", "import"), ("use A;", "php", "import"), ("use A;", "swift", None),
]


@query(values(_LINES, "line, language, kind"))
def line_kinds(spark, d):
    """What a line begins, by language."""
    rows = spark.createDataFrame([r[:2] for r in _LINES], "line string, language string")
    return rows.select("line", "language", reducers.line_kinds(F.col("line"), F.col("language")).alias("kind"))


@query(f"""SELECT page_id, i, strlen(line) - strlen(ltrim(line, ' ' || chr(9))) AS indent, string_split(line, ':')[1] AS role FROM ({sql_lines("(SELECT page_id, chr(9) || '  ' || url || chr(10) || html AS t FROM pages)", 'page_id', 't')}) WHERE i <= 3""")
def line_measures(spark, d):
    """Indentation and role of the first lines of pages."""
    text = F.concat(F.lit("\t  "), "url", F.lit("\n"), "html")
    rows = table(spark, d, "pages").select("page_id", F.posexplode(T.first_lines(text, 3)).alias("at", "line")).where("line <> '' OR at < 2")
    return rows.select("page_id", (F.col("at") + 1).cast("long").alias("i"), T.indent_width(F.col("line")).cast("long").alias("indent"), T.role_of(F.col("line")).alias("role"))


# ---- patches

_COMMON = [f"a line that all rows of a brand share, number {i}" for i in range(10)]
_SHARED = f" || {NL} || ".join(f"'{x}'" for x in _COMMON)
_ROW = "'row ' || lpad({}::VARCHAR, 6, '0')"


def _rows(spark, d):
    """Rows of a brand in order: ten shared lines and one of their own."""
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).cast("bigint")
    rows = table(spark, d, "part").select(F.col("p_brand").alias("session_id"), seq.alias("seq"))
    return rows.withColumn("content", F.concat(F.lit("\n".join(_COMMON) + "\nrow "), F.lpad(F.col("seq").cast("string"), 6, "0")))


@query(f"""WITH s AS (SELECT p_brand AS session_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS seq FROM part),
 p AS (SELECT session_id, seq, seq - 1 AS base_seq, sha256({_SHARED} || {NL} || {_ROW.format('(seq - 1)')}) AS base_hash,
  '--- original' || {NL} || '+++ modified' || {NL} || '@@ -8,4 +8,4 @@' || {NL} || ' {_COMMON[7]}' || {NL} || ' {_COMMON[8]}' || {NL} || ' {_COMMON[9]}' || {NL} || '-' || {_ROW.format('(seq - 1)')} || {NL} || '+' || {_ROW.format('seq')} || {NL} AS diff_text FROM s WHERE seq > 1)
 SELECT *, ceil(strlen(diff_text) / 3.5)::BIGINT AS diff_tokens FROM p""")
def diff_best(spark, d):
    """Each row's patch against the newest of the earlier rows that save most."""
    return diffs.best_diffs(_rows(spark, d))


@query(f"SELECT p_brand AS session_id, seq, sha256({_SHARED} || {NL} || {_ROW.format('seq')}) AS hash FROM (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS seq FROM part) WHERE seq > 1")
def diff_reconstruct(spark, d):
    """Texts again, from the patches and the stored originals."""
    rows = _rows(spark, d)
    store = rows.select(F.col("seq").alias("id"), T.content_hash(F.col("content")).alias("original_hash"), F.col("content").alias("original"))
    found = diffs.best_diffs(rows).select("session_id", "seq", "base_hash", "diff_text")
    return diffs.reconstruct(found, store).select("session_id", "seq", T.content_hash(F.col("content")).alias("hash"))


@query(f"""SELECT doc_id, TRUE AS encoded, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE sha256(text) END AS base_hash, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS diff_text FROM documents""")
def diff_encoding(spark, d):
    """Encoded patches and their parts; a marker without a whole hash has none."""
    whole = diffs.encode(T.content_hash(F.col("text")), F.col("source"))
    text = F.when(F.col("doc_id") % 3 == 0, F.lit(diffs.MARKER + "abc")).otherwise(whole)
    x = diffs.parse_encoded(text)
    return docs(spark, d).select("doc_id", diffs.is_encoded(text).alias("encoded"), x["base_hash"].alias("base_hash"), x["diff_text"].alias("diff_text"))


_RUN = f"p_name || {NL} || p_name || {NL} || p_name"


@query(f"""SELECT DISTINCT sha256({_RUN}) AS hash, '--- original' || {NL} || '+++ modified' || {NL} || '@@ -1,3 +1,2 @@' || {NL} || ' ' || p_name || {NL} || '-' || p_name || {NL} || '-' || p_name || {NL} || '+[... 3 similar lines]' || {NL} AS unified_diff,
 strlen({_RUN})::BIGINT AS original_bytes, (strlen(p_name) + 22)::BIGINT AS compressed_bytes, ceil(strlen({_RUN}) / 3.5)::BIGINT AS original_tokens, ceil((strlen(p_name) + 22) / 3.5)::BIGINT AS compressed_tokens,
 (1 - ceil((strlen(p_name) + 22) / 3.5)::DOUBLE / ceil(strlen({_RUN}) / 3.5)::DOUBLE) * 100 AS savings_pct, 'command_output' AS content_type FROM part""")
def diff_report(spark, d):
    """What reducing changed, by hash."""
    text = F.concat_ws("\n", "p_name", "p_name", "p_name")
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("s").alias("session_id"), text.alias("content"), F.lit("command_output").alias("type_hint"))
    store = S.measure(rows).withColumnRenamed("content", "original")
    return diffs.diff_report(store, store.select("original_hash"))
