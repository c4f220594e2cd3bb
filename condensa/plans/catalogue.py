"""Queries of the reduction engine by name, and their SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from condensa.functions import levels as L
from condensa.functions import text as T
from condensa.operators import analytics as A
from condensa.operators import budget as B
from condensa.operators import classify as C
from condensa.operators import diffs, reducers
from condensa.plans.registry import ORACLES, QUERIES, docs, query, spread, table  # noqa: F401
from condensa.sources import store as S


@query("SELECT doc_id, ceil(strlen(text) / 3.5)::BIGINT AS tokens, sha256(text) AS hash FROM documents")
def tokens_and_hash(spark, d):
    return docs(spark, d).select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens"), T.content_hash(F.col("text")).alias("hash"))


_LINES = "(CASE WHEN text LIKE '%' || chr(10) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END)"


@query(f"SELECT doc_id, len({_LINES})::BIGINT AS n_lines FROM documents")
def line_count(spark, d):
    return docs(spark, d).select("doc_id", F.size(T.lines(F.col("text"))).cast("bigint").alias("n_lines"))


@query("SELECT doc_id, CASE WHEN strlen(text) <= 100 THEN text ELSE left(text, list_max(list_filter(range(1, 101), lambda i: strlen(left(text, i)) <= 100))) || '...' END AS cut FROM documents")
def byte_cut(spark, d):
    return docs(spark, d).select("doc_id", T.cut_bytes(F.col("text"), 100).alias("cut"))


_FIRST5 = "string_split(text, chr(10))[1:5]"
_CMD = " OR ".join(f"contains(l, '{m}')" for m in L.COMMAND_MARKS)
_ROLE = " OR ".join(f"starts_with(l, '{r}')" for r in L.ROLES)
_LANG = """CASE WHEN contains(text, 'fn main()') OR contains(text, 'pub fn ') OR contains(text, 'impl ') THEN 'rust'
 WHEN contains(text, 'func ') AND contains(text, 'package ') THEN 'go'
 WHEN contains(text, 'def ') AND contains(text, 'import ') AND NOT contains(text, '{') THEN 'python'
 WHEN contains(text, 'interface ') AND contains(text, ': ') AND contains(text, 'export ') THEN 'typescript'
 WHEN contains(text, 'function ') OR contains(text, 'const ') OR contains(text, '=> {') THEN 'javascript'
 WHEN contains(text, 'public class ') OR contains(text, 'public static void main') THEN 'java' END"""
_TOOL = "json_exists({x}, '$.name') AND json_exists({x}, '$.input_schema')"
_JSON = f"""CASE WHEN left(ltrim(text, ' ' || chr(9) || chr(10) || chr(13)), 1) IN ('{{', '[') AND json_valid(text) THEN
 CASE WHEN json_type(text) = 'OBJECT' AND {_TOOL.format(x='text')} OR json_type(text) = 'ARRAY' AND len(list_filter(json_extract(text, '$[*]'), lambda x: {_TOOL.format(x='x')})) > 0 THEN 'mcp_schema' ELSE 'json' END END"""
_TYPE = f"""CASE WHEN strlen(trim(text)) < 10 THEN 'unknown' WHEN ({_JSON}) IS NOT NULL THEN ({_JSON})
 WHEN contains(text, chr(27) || '[') OR len(list_filter({_FIRST5}, lambda l: {_CMD})) > 0 THEN 'command_output'
 WHEN {_LANG} IS NOT NULL THEN 'code:' || ({_LANG})
 WHEN len(list_filter(string_split(text, chr(10))[1:20], lambda l: {_ROLE})) >= 2 THEN 'conversation' ELSE 'unknown' END"""


@query(f"SELECT doc_id, {_TYPE} AS content_type FROM documents")
def detect_type(spark, d):
    return spread(docs(spark, d).select("doc_id", "text")).select("doc_id", C.content_type(F.col("text")).alias("content_type"))


@query(f"SELECT page_id, ({_LANG.replace('text', 'html')}) AS language FROM pages")
def detect_language(spark, d):
    return table(spark, d, "pages").select("page_id", C.language_of(F.col("html")).alias("language"))


_ENDS = ["rs", "TSX", "hpp", "kts", "txt", "py", "mjs", "go"]
_EXT_CASE = " ".join(f"WHEN '{e}' THEN '{n}'" for n, es in L.EXTENSIONS.items() for e in es)
_PATH = "'src/f' || l_linenumber || '.' || (" + str(_ENDS).replace('"', "'") + ")[l_orderkey % 8 + 1]"


@query(f"SELECT path, CASE lower(string_split(path, '.')[-1]) {_EXT_CASE} END AS language, count(*) AS n FROM (SELECT {_PATH} AS path FROM lineitem) GROUP BY 1, 2")
def language_by_path(spark, d):
    end = F.element_at(F.array(*map(F.lit, _ENDS)), (F.col("l_orderkey") % 8 + 1).cast("int"))
    rows = table(spark, d, "lineitem").select(F.concat(F.lit("src/f"), F.col("l_linenumber").cast("string"), F.lit("."), end).alias("path"))
    return rows.groupBy("path").agg(F.count("*").alias("n")).select("path", C.language_of_path(F.col("path")).alias("language"), "n")


@query(f"SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'command_output' WHEN 1 THEN 'code:rust' ELSE {_TYPE} END AS content_type FROM documents")
def route_by_tool(spark, d):
    tool = F.element_at(F.array(*map(F.lit, ["Bash", "Edit", "Read", "Other"])), (F.col("doc_id") % 4 + 1).cast("int"))
    return docs(spark, d).select("doc_id", C.type_of_tool(tool, F.col("text")).alias("content_type"))


_ANSI_TEXT = "chr(27) || '[32m' || event_type || chr(27) || '[0m ' || user_id"


@query(f"SELECT event_id, event_type || ' ' || user_id AS plain, contains({_ANSI_TEXT}, chr(27) || '[') AS had_ansi FROM events")
def strip_ansi(spark, d):
    t = F.concat(F.lit("\x1b[32m"), "event_type", F.lit("\x1b[0m "), F.col("user_id").cast("string"))
    return table(spark, d, "events").select("event_id", T.strip_ansi(t).alias("plain"), C.has_ansi(t).alias("had_ansi"))


@query("""SELECT p_partkey, CASE WHEN p_name = p_type THEN 1.0 ELSE
 len(list_filter(range(1, least(length(p_name), length(p_type)) + 1), lambda i: substr(p_name, i, 1) = substr(p_type, i, 1)))::DOUBLE / greatest(strlen(p_name), strlen(p_type)) END AS similarity FROM part""")
def line_similarity(spark, d):
    return table(spark, d, "part").select("p_partkey", T.line_similarity(F.col("p_name"), F.col("p_type")).cast("double").alias("similarity"))


_LOG = "SELECT user_id, string_agg(event_type, chr(10) ORDER BY ts, event_id) AS content FROM events GROUP BY user_id"


def logs(spark, d):
    rows = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("x"))
    return rows.select("user_id", F.array_join(F.transform("x", lambda e: e["event_type"]), "\n").alias("content"))


_RUNS = f"""WITH logs AS ({_LOG}), l AS (SELECT user_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM logs),
 m AS (SELECT *, CASE WHEN line = lag(line) OVER (PARTITION BY user_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM l),
 g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY i) AS run FROM m),
 r AS (SELECT user_id, run, min(line) AS line, count(*) AS n FROM g GROUP BY 1, 2),
 o AS (SELECT user_id, run, CASE WHEN n = 1 THEN [line] WHEN n = 2 THEN [line, line] ELSE [line, '[... ' || n || ' similar lines]'] END AS rows FROM r),
 f AS (SELECT user_id, flatten(list(rows ORDER BY run)) AS rows FROM o GROUP BY user_id)"""


@query(_RUNS + " SELECT user_id, CASE WHEN len(rows) <= 200 THEN array_to_string(rows, chr(10)) ELSE array_to_string(rows[1:200], chr(10)) || chr(10) || '[... ' || (len(rows) - 200) || ' more lines truncated]' END AS reduced FROM f")
def reduce_logs_light(spark, d):
    return logs(spark, d).select("user_id", reducers.reduced(F.col("content"), F.lit("command_output"), F.lit("light")).alias("reduced"))


@query(_RUNS + " SELECT user_id, CASE WHEN len(rows) <= 30 THEN array_to_string(rows, chr(10)) ELSE array_to_string(rows[1:30], chr(10)) || chr(10) || '[... ' || (len(rows) - 30) || ' more lines truncated]' END AS reduced FROM f")
def reduce_logs_aggressive(spark, d):
    return logs(spark, d).select("user_id", reducers.reduced(F.col("content"), F.lit("command_output"), F.lit("aggressive")).alias("reduced"))


_TURNS = "SELECT conv_id, turn, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations"


def _signal(weight: float, *marks: str) -> str:
    return "CASE WHEN " + " OR ".join("contains(text, '" + m.replace("'", "''") + "')" for m in marks) + f" THEN {weight}::DOUBLE ELSE 0.0 END"


_SIGNALS = " + ".join([
    _signal(0.3, "```"), _signal(0.15, ".rs", ".ts", ".py", ".js", "/src/", "\\src\\"),
    _signal(0.2, "I'll ", "Let's ", "We should", "The fix is", "I've decided", "Going with"), _signal(0.25, "error", "Error", "failed", "FAILED", "panic"),
])


@query(f"SELECT conv_id, turn, least(1.0::DOUBLE, (i::DOUBLE / n) * 0.3 + {_SIGNALS}) AS score FROM ({_TURNS})")
def turn_scores(spark, d):
    """All signals of a turn's score."""
    w = Window.partitionBy("conv_id")
    rows = table(spark, d, "conversations").withColumn("i", F.row_number().over(w.orderBy("turn", "text")) - 1).withColumn("n", F.count("*").over(w))
    score = reducers.scored_turn(F.col("text"), F.col("i"), F.col("n"))
    return rows.select("conv_id", "turn", score.alias("score"))


_ITEMS = "SELECT l_orderkey, '[' || string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) || ']' AS content, list(l_linenumber ORDER BY l_linenumber) AS xs, count(*) AS n FROM lineitem GROUP BY 1"


@query(f"""SELECT l_orderkey, '[' || chr(10) || array_to_string(list_transform(CASE WHEN n <= 5 THEN xs::VARCHAR[] ELSE list_concat(xs[1:2]::VARCHAR[], ['"... ' || (n - 5) || ' more items (' || n || ' total)"'], xs[-3:]::VARCHAR[]) END, lambda x: '  ' || x), ',' || chr(10)) || chr(10) || ']' AS reduced FROM ({_ITEMS})""")
def json_array_sample(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("xs"))
    return rows.select("l_orderkey", reducers.reduced(F.to_json("xs"), F.lit("json"), F.lit("medium")).alias("reduced"))


@query("SELECT p_brand, CASE WHEN p_partkey % 3 = 0 THEN 'core' ELSE string_split(lower(p_type) || '__' || p_partkey, '__')[1] END AS ns, count(*) AS n FROM part GROUP BY 1, 2")
def tool_namespaces(spark, d):
    name = F.when(F.col("p_partkey") % 3 == 0, F.lower("p_type")).otherwise(F.concat(F.lower("p_type"), F.lit("__"), F.col("p_partkey").cast("string")))
    return table(spark, d, "part").groupBy("p_brand", reducers.namespaces(name).alias("ns")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, p_size, CASE WHEN p_size > 50 THEN 'summary' ELSE 'full' END AS light,
 CASE WHEN p_size > 30 THEN 'signature' WHEN p_size > 10 THEN 'summary' ELSE 'full' END AS medium,
 CASE WHEN p_size > 10 THEN 'signature' WHEN p_size > 5 THEN 'summary' ELSE 'full' END AS aggressive FROM part""")
def fold_decisions(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_size", *(reducers.fold_decisions(F.col("p_size"), v).alias(v) for v in L.LEVELS))


@query("SELECT s_suppkey, 'fn f' || s_suppkey || '() ' || CASE WHEN s_suppkey % 40 + 2 > 10 THEN '{ /* ... ' || (s_suppkey % 40 + 2) || ' lines */ }' WHEN s_suppkey % 40 + 2 > 6 THEN '{' || chr(10) || '    a();' || chr(10) || '    a();' || chr(10) || '    // ... ' || (s_suppkey % 40 - 3) || ' lines folded ...' || chr(10) || '    a();' || chr(10) || '}' ELSE '{' || chr(10) || repeat('    a();' || chr(10), s_suppkey % 40) || '}' END AS reduced FROM supplier")
def code_fold(spark, d):
    body = F.repeat(F.lit("    a();\n"), (F.col("s_suppkey") % 40).cast("int"))
    code = F.concat(F.lit("fn f"), F.col("s_suppkey").cast("string"), F.lit("() {\n"), body, F.lit("}"))
    return table(spark, d, "supplier").select("s_suppkey", reducers.reduced(code, F.lit("code:rust"), F.lit("aggressive")).alias("reduced"))


_SET = "list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''))"


@query(f"""WITH s AS (SELECT source AS session_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS seq, {_SET} AS ls FROM documents)
 SELECT a.session_id, a.seq, b.seq AS base_seq, len(list_intersect(a.ls, b.ls))::DOUBLE / len(list_distinct(list_concat(a.ls, b.ls))) AS jaccard
 FROM s a JOIN s b ON a.session_id = b.session_id AND b.seq BETWEEN a.seq - 20 AND a.seq - 1 WHERE len(list_intersect(a.ls, b.ls))::DOUBLE / len(list_distinct(list_concat(a.ls, b.ls))) >= 0.6""")
def similar_recent(spark, d):
    # the texts are hashed before they are numbered, so that no window carries them
    rows = spread(docs(spark, d).select("doc_id", "source", "text")).select("doc_id", F.col("source").alias("session_id"), diffs.line_hashes(F.col("text")).alias("lines"))
    seq = F.row_number().over(Window.partitionBy("session_id").orderBy("doc_id")).cast("bigint")
    return diffs.similar_earlier(rows.select("session_id", seq.alias("seq"), "lines"))


def events(spark, d):
    """Reduction events of the documents: the session is the source, the reduced size half of the tokens, or all of few."""
    o = T.estimated_tokens(F.col("text"))
    kind = F.element_at(F.array(*map(F.lit, ["code:rust", "command_output", "json", "conversation"])), (F.col("doc_id") % 4 + 1).cast("int"))
    return docs(spark, d).select(F.col("doc_id").alias("id"), F.col("source").alias("session_id"), kind.alias("content_type"), T.content_hash(F.col("text")).alias("original_hash"), o.alias("original_tokens"), F.when(F.col("doc_id") % 3 == 0, o).otherwise(F.floor(o / 2)).cast("bigint").alias("compressed_tokens"))


_EV = "SELECT doc_id AS id, source AS session_id, ['code:rust', 'command_output', 'json', 'conversation'][doc_id % 4 + 1] AS content_type, sha256(text) AS original_hash, ceil(strlen(text) / 3.5)::BIGINT AS o, CASE WHEN doc_id % 3 = 0 THEN ceil(strlen(text) / 3.5)::BIGINT ELSE floor(ceil(strlen(text) / 3.5) / 2)::BIGINT END AS c FROM documents"
_ST = f"SELECT session_id, content_type, sum(o)::BIGINT AS original_tokens, sum(c)::BIGINT AS compressed_tokens, count(*) AS n, CASE WHEN sum(o) > 0 THEN 1 - sum(c)::DOUBLE / sum(o)::DOUBLE ELSE 0.0 END AS ratio FROM ({_EV}) GROUP BY 1, 2"


@query(_ST)
def session_stats(spark, d):
    return A.type_stats(events(spark, d))


@query(f"""SELECT session_id, sum(original_tokens)::BIGINT AS original_tokens, sum(compressed_tokens)::BIGINT AS compressed_tokens, sum(n)::BIGINT AS n, greatest(sum(original_tokens) - sum(compressed_tokens), 0)::BIGINT AS tokens_saved,
 1 - sum(compressed_tokens)::DOUBLE / sum(original_tokens)::DOUBLE AS ratio, string_agg(content_type || ' ' || original_tokens || ' ' || compressed_tokens || ' ' || n, ', ' ORDER BY original_tokens DESC, content_type) AS by_type FROM ({_ST}) GROUP BY 1""")
def session_totals(spark, d):
    types = F.transform("by_type", lambda t: F.concat_ws(" ", t["content_type"], t["original_tokens"].cast("string"), t["compressed_tokens"].cast("string"), t["n"].cast("string")))
    return A.session_totals(events(spark, d)).withColumn("by_type", F.array_join(types, ", "))


@query(f"""SELECT session_id, n, score, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 70 THEN 'good' WHEN score >= 50 THEN 'moderate' ELSE 'poor' END AS assessment,
 CASE WHEN score < 70 THEN 'Use level light or medium for better quality.' END AS recommendation FROM (
 SELECT session_id, sum(n)::BIGINT AS n, CASE WHEN sum(n) < 3 THEN 50.0::DOUBLE ELSE greatest(0.0, least(100.0, 80.0 + sum(CASE WHEN ratio > 0.9 THEN -10.0 WHEN ratio > 0.7 THEN -3.0 WHEN ratio >= 0.3 THEN 2.0 ELSE 0.0 END)))::DOUBLE END AS score FROM ({_ST}) GROUP BY 1)""")
def quality_score(spark, d):
    return A.quality(events(spark, d))


_CLASS = f"SELECT session_id, sum(original_tokens)::BIGINT AS total, CASE WHEN sum(original_tokens) = 0 THEN 'empty' WHEN sum(original_tokens) FILTER (content_type = 'command_output') / sum(original_tokens) > 0.5 THEN 'debugging' WHEN sum(original_tokens) FILTER (content_type LIKE 'code%') / sum(original_tokens) > 0.5 THEN 'code_review' ELSE 'feature_build' END AS session_class FROM ({_ST}) GROUP BY 1"


@query(_CLASS)
def session_class(spark, d):
    return A.session_class(events(spark, d))


@query(f"""SELECT session_id, -original_tokens AS place, 'Raise the level for ''' || content_type || ''': only ' || format('{{:.0f}}', ratio * 100) || '% saved on ' || original_tokens || ' tokens' AS advice FROM ({_ST}) WHERE ratio < 0.3 AND original_tokens > 1000
 UNION ALL SELECT session_id, 1, CASE session_class WHEN 'debugging' THEN 'Debugging session: reduce command output at level aggressive.' ELSE 'Code review session: fold reviewed files at level aggressive.' END FROM ({_CLASS}) WHERE session_class IN ('debugging', 'code_review')""")
def recommendations(spark, d):
    return A.recommendations(events(spark, d))


@query(f"SELECT session_id, content_type, original_tokens, rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY original_tokens DESC, content_type)::INT AS rank FROM ({_ST})) WHERE rank <= 3")
def top_consumers(spark, d):
    return A.top_consumers(events(spark, d), 3).select("session_id", "content_type", "original_tokens", "rank")


@query(f"SELECT original_hash, max(id) AS id, arg_max(session_id, id) AS session_id, arg_max(o, id) AS original_tokens FROM ({_EV}) GROUP BY 1")
def latest_by_hash(spark, d):
    return S.latest_by_hash(events(spark, d), "id", "session_id", "original_tokens")


@query("WITH h AS (SELECT sha256(text) AS original_hash, text, doc_id FROM documents) SELECT a.original_hash, b.text AS original FROM (SELECT DISTINCT original_hash FROM h) a JOIN (SELECT original_hash, max(text) AS text FROM h GROUP BY 1) b USING (original_hash)")
def expand_by_hash(spark, d):
    rows = docs(spark, d).select(F.col("doc_id").alias("id"), T.content_hash(F.col("text")).alias("original_hash"), F.col("text").alias("original"), F.col("text").alias("compressed"))
    return S.expand(rows, rows.select("original_hash").distinct())


@query(f"SELECT session_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id DESC)::INT AS rank FROM ({_EV})) WHERE rank <= 20")
def recent_items(spark, d):
    return S.recent_items(events(spark, d)).select("session_id", "id", "rank")


_ACC = "SELECT event_type AS project, 'user_' || user_id AS file, ts FROM events"


@query(f"SELECT project, file, access_count, rank FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY access_count DESC, file)::INT AS rank FROM (SELECT project, file, count(*) AS access_count FROM ({_ACC}) GROUP BY 1, 2)) WHERE rank <= 20")
def top_files(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("project"), F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("file"), "ts")
    return S.top_files(rows).select("project", "file", "access_count", "rank")


@query("SELECT user_id::VARCHAR AS session_id, event_type AS tool_name, count(*) AS call_count FROM events GROUP BY 1, 2")
def tool_usage(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("tool_name"), "ts")
    return S.count_tool_usage(rows).drop("last_used_at")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 10 < 0.05 THEN 70.0 WHEN l_discount * 10 > 0.95 THEN 75.0 WHEN l_discount * 10 >= 0.3 AND l_discount * 10 <= 0.8 THEN 95.0 ELSE 88.0 END::DOUBLE AS quality FROM lineitem")
def bench_quality(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", A.bench_quality(F.col("l_discount") * 10).alias("quality"))


_CAT = "CASE WHEN content_type LIKE 'code%' THEN 'code' WHEN content_type = 'conversation' THEN 'conversation' WHEN content_type = 'mcp_schema' THEN 'mcp' ELSE 'tool_output' END"
_LIMIT = "CASE category WHEN 'conversation' THEN 40000 WHEN 'tool_output' THEN 30000 WHEN 'code' THEN 20000 ELSE 10000 END"


@query(f"""SELECT session_id, id, category, used_before, CASE WHEN used_before / ({_LIMIT}) < 0.5 THEN 'light' WHEN used_before / ({_LIMIT}) < 0.8 THEN 'medium' ELSE 'aggressive' END AS level FROM (
 SELECT session_id, id, category, coalesce(sum(c) OVER (PARTITION BY session_id, category ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used_before FROM (SELECT *, {_CAT} AS category FROM ({_EV})))""")
def budget_levels(spark, d):
    rows = events(spark, d).select("session_id", "id", B.category_of(F.col("content_type")).alias("category"), F.col("id").alias("seq"), F.col("compressed_tokens").alias("tokens"))
    return B.running_usage(rows).select("session_id", "id", "category", "used_before", "level")
