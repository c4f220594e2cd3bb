"""Queries of the sources, the store, the service, budgets and the bench, and their SQL."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condensa.functions import levels as L
from condensa.functions import text as T
from condensa.functions.sql import register
from condensa.operators import analytics as A
from condensa.operators import budget as B
from condensa.operators import samples
from condensa.plans.catalogue import _CAT, _EV, _LIMIT, events
from condensa.plans.reductions import NL, sql_lines, sql_reduced_output
from condensa.plans.registry import query, table, values
from condensa.sources import store as S
from condensa.streaming import service

# ---- sources and store


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that the cluster names; in local mode below the machine's own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="condensa-")
    return f"{base}/{uuid.uuid4().hex}"


@query(f"SELECT n_name AS name, sha256('nation ' || n_name || {NL} || 'of region ' || n_regionkey || {NL}) AS hash FROM nation")
def read_blobs(spark, d):
    """Whole text files, each one blob."""
    path = shared_folder(spark)
    text = F.concat(F.lit("nation "), "n_name", F.lit("\nof region "), F.col("n_regionkey").cast("string"))
    table(spark, d, "nation").select("n_name", text.alias("value")).repartition("n_name").write.partitionBy("n_name").text(path)
    rows = S.read_blobs(spark, path)
    return rows.select(F.regexp_extract("path", "n_name=([^/]+)", 1).alias("name"), T.content_hash(F.col("content")).alias("hash")).select(F.url_decode("name").alias("name"), "hash")


def _event_lines(spark, d) -> DataFrame:
    """Tool events as JSON lines; every tenth line is no event."""
    tool = F.element_at(F.array(*map(F.lit, ["Bash", "Edit", "Read", "Other"])), (F.col("event_id") % 4 + 1).cast("int"))
    said = F.concat_ws("\n", *[F.concat("event_type", F.lit(" by "), F.col("user_id").cast("string"))] * 3)
    event = F.to_json(F.struct(tool.alias("tool_name"), F.struct(F.col("user_id").alias("user")).alias("tool_input"), said.alias("tool_output")))
    return table(spark, d, "events").select(F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("no event "), F.col("event_id").cast("string"))).otherwise(event).alias("value"))


_SAID = "event_type || ' by ' || user_id"
_EVENT_ROWS = f"""SELECT CASE WHEN event_id % 10 = 0 THEN NULL ELSE ['Bash', 'Edit', 'Read', 'Other'][event_id % 4 + 1] END AS tool_name,
 CASE WHEN event_id % 10 = 0 THEN 'unknown' ELSE ['command_output', 'code:rust', 'unknown', 'unknown'][event_id % 4 + 1] END AS content_type,
 CASE WHEN event_id % 10 = 0 THEN 'no event ' || event_id WHEN event_id % 4 = 1 THEN {_SAID} || {NL} || {_SAID} || {NL} || {_SAID} ELSE {_SAID} || {NL} || '[... 3 similar lines]' END AS output FROM events"""


@query(f"SELECT tool_name, content_type, output, count(*) AS n FROM ({_EVENT_ROWS}) GROUP BY ALL")
def tool_events(spark, d):
    """Tool events read, routed by tool and reduced; lines that are no events pass."""
    out = service.reduce_events(_event_lines(spark, d))
    return out.groupBy("tool_name", "content_type", "output").agg(F.count("*").alias("n"))


def _stored(spark, d) -> DataFrame:
    """Parts as events of a store: three equal lines each, twice, the second time with its own level."""
    rows = table(spark, d, "part").select("p_partkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("again"), F.concat_ws("\n", "p_name", "p_name", "p_name").alias("content"))
    rows = rows.select((F.col("p_partkey") * 2 + F.col("again")).alias("id"), F.concat(F.lit("s"), (F.col("p_partkey") % 5).cast("string")).alias("session_id"), "content", F.when(F.col("again") == 1, "light").otherwise("medium").alias("level"), F.lit("command_output").alias("type_hint"))
    return S.measure(rows)


_THRICE = f"p_name || {NL} || p_name || {NL} || p_name"


@query(f"SELECT sha256({_THRICE}) AS original_hash, {_THRICE} AS original, p_name || {NL} || '[... 3 similar lines]' AS compressed, max(p_partkey) * 2 + 1 AS id, 'light' AS level, count(*) * 2 AS n FROM part GROUP BY p_name")
def stored_pairs(spark, d):
    """The store written and read again: each hash's newest original, reduced form and level."""
    path = shared_folder(spark)
    S.append(_stored(spark, d), path)
    store = spark.read.parquet(path)
    pairs = S.latest_by_hash(store, "original", "compressed", "id", "level")
    return pairs.join(store.groupBy("original_hash").agg(F.count("*").alias("n")), "original_hash")


@query("""WITH a AS (SELECT event_type AS project, 'user_' || user_id AS file FROM events), g AS (SELECT DISTINCT event_type AS project, 'user_' || (user_id % 40) AS file FROM events),
 c AS (SELECT project, file, count(*) AS access_count FROM (SELECT * FROM a UNION ALL SELECT * FROM g) GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY access_count DESC, file) AS rank FROM c)
 SELECT project, (SELECT count(*) FROM g WHERE g.project = r.project) AS recent_files, count(*) AS tracked_files, string_agg(file || ' ' || access_count, ', ' ORDER BY rank) AS top_files FROM r WHERE rank <= 20 GROUP BY project""")
def project_profile(spark, d):
    """Files of a change log and of accesses: how many, and the most used."""
    log = table(spark, d, "events").select(F.col("event_type").alias("project"), F.explode(F.array(F.concat(F.lit("user_"), (F.col("user_id") % 40).cast("string")), F.lit(" "), F.lit(""))).alias("value"))
    accesses = table(spark, d, "events").select(F.col("event_type").alias("project"), F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("file"), "ts")
    out = S.project_profile(log, accesses)
    return out.withColumn("top_files", F.array_join(F.transform("top_files", lambda f: F.concat_ws(" ", f["path"], f["access_count"].cast("string"))), ", "))


# ---- service


def _call(name: str, **arguments) -> F.Column:
    args = F.struct(*(v.alias(k) for k, v in arguments.items())) if arguments else F.create_map().cast("map<string,string>")
    key = F.col("p_partkey")
    ident = F.when(key % 2 == 0, F.concat(F.lit('"k'), key.cast("string"), F.lit('"'))).otherwise(key.cast("string"))
    params = F.to_json(F.struct(F.lit(name).alias("name"), args.alias("arguments")))
    return F.concat(F.lit('{"jsonrpc":"2.0","id":'), ident, F.lit(',"method":"tools/call","params":'), params, F.lit("}"))


def _method(name: str) -> F.Column:
    return F.concat(F.lit('{"jsonrpc":"2.0","id":'), F.col("p_partkey").cast("string"), F.lit(f',"method":"{name}"}}'))


_TOKENS = f"ceil(strlen({_THRICE}) / 3.5)::BIGINT"
_AFTER = "ceil((strlen(p_name) + 22) / 3.5)::BIGINT"
_PERCENT = f"printf('%.1f%%', (1 - {_AFTER}::DOUBLE / {_TOKENS}::DOUBLE) * 100)"
_SESSION = f"""SELECT 's' || p_partkey % 5 AS session_id, 2 * sum({_TOKENS})::BIGINT AS o, 2 * sum({_AFTER})::BIGINT AS c, 2 * count(*) AS n FROM part GROUP BY 1"""


@query(f"""WITH t AS ({_SESSION}) SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN 'result' WHEN 6 THEN 'result' WHEN 7 THEN 'error' WHEN 8 THEN 'error' WHEN 9 THEN 'result' ELSE 'result' END AS outcome,
 CASE WHEN p_partkey % 10 = 8 THEN NULL WHEN p_partkey % 10 IN (6, 7) THEN p_partkey::VARCHAR WHEN p_partkey % 2 = 0 THEN 'k' || p_partkey ELSE p_partkey::VARCHAR END AS id,
 CASE p_partkey % 10 WHEN 7 THEN -32601 WHEN 8 THEN -32700 END AS code,
 CASE p_partkey % 10 WHEN 0 THEN FALSE WHEN 1 THEN TRUE WHEN 2 THEN FALSE WHEN 3 THEN TRUE WHEN 4 THEN FALSE WHEN 5 THEN TRUE WHEN 9 THEN FALSE END AS failed,
 CASE p_partkey % 10
  WHEN 0 THEN '{{' || {NL} || '  "compressed": "' || p_name || '\\n[... 3 similar lines]",' || {NL} || '  "compressed_tokens": ' || {_AFTER} || ',' || {NL} || '  "content_type": "command_output",' || {NL} || '  "hash": "' || sha256({_THRICE}) || '",' || {NL} || '  "original_tokens": ' || {_TOKENS} || ',' || {NL} || '  "ratio": "' || {_PERCENT} || '"' || {NL} || '}}'
  WHEN 1 THEN 'Missing required field: content' WHEN 2 THEN {_THRICE} WHEN 3 THEN 'content not found for hash none'
  WHEN 4 THEN '{{' || {NL} || '  "session_id": "' || t.session_id || '",' || {NL} || '  "total_original_tokens": ' || o || ',' || {NL} || '  "total_compressed_tokens": ' || c || ',' || {NL} || '  "tokens_saved": ' || greatest(o - c, 0) || ',' || {NL} || '  "overall_ratio": '
  WHEN 5 THEN 'Unknown tool: zap'
  WHEN 9 THEN '{{' || {NL} || '  "hash": "' || sha256({_THRICE}) || '",' || {NL} || '  "unified_diff": "--- original\\n+++ modified\\n@@ -1,3 +1,2 @@\\n ' || p_name || '\\n-' || p_name || '\\n-' || p_name || '\\n+[... 3 similar lines]\\n",' || {NL} || '  "original_bytes": ' || strlen({_THRICE}) || ',' END AS text
 FROM part LEFT JOIN t ON t.session_id = 's' || p_partkey % 5""")
def service_requests(spark, d):
    """Every kind of request against a store; long answers are shown up to their first figures that need no rounding."""
    text = F.concat_ws("\n", "p_name", "p_name", "p_name")
    kinds = [
        _call("compress", content=text, type=F.lit("output"), level=F.lit("medium")), _call("compress"), _call("expand", hash=T.content_hash(text)), _call("expand", hash=F.lit("none")),
        _call("stats", session_id=F.concat(F.lit("s"), (F.col("p_partkey") % 5).cast("string"))), _call("zap"), _method("ping"), _method("zap"), F.lit("{broken"), _call("diff", hash=T.content_hash(text)),
    ]
    line = F.element_at(F.array(*kinds), (F.col("p_partkey") % 10 + 1).cast("int"))
    rows = table(spark, d, "part").select(line.alias("value")).where("value <> '{broken'")
    answers = service.answer_requests(rows, _stored(spark, d).withColumnRenamed("content", "original"))
    # a broken line has no id to know it by: each is answered alone
    broken = table(spark, d, "part").where("p_partkey % 10 = 8").select("p_partkey", F.lit("{broken").alias("value"))
    bad = service.answer_requests(broken.select("value").limit(1)).select("response")
    parsed = "id string, error struct<code:int>, result struct<isError:boolean,content:array<struct<text:string>>>"
    both = answers.withColumn("p_partkey", F.regexp_extract("response", '"id":"?k?([0-9]+)', 1).cast("bigint")).unionByName(broken.select("p_partkey").join(bad).select("response", "p_partkey"))
    r = F.from_json("response", parsed)
    kind = F.col("p_partkey") % 10
    whole = F.get(r["result"]["content"], 0)["text"]
    shown = F.when(kind == 4, F.regexp_extract(whole, '(?s)^(.*"overall_ratio": )', 1)).when(kind == 9, F.regexp_extract(whole, '(?s)^(.*"original_bytes": [0-9]+,)', 1)).otherwise(whole)
    outcome = F.when(r["error"].isNotNull(), "error").otherwise("result")
    return both.select("p_partkey", outcome.alias("outcome"), r["id"].alias("id"), r["error"]["code"].alias("code"), r["result"]["isError"].alias("failed"), shown.alias("text"))


@query(values([("initialize", "condensa", None), ("tools/list", None, "compress, expand, stats, bench, diff")], "method, server, tools"))
def service_methods(spark, d):
    """The handshake and the list of calls; a notification, an empty line and a list get no answer."""
    lines = ['{"id":1,"method":"initialize"}', '{"id":2,"method":"tools/list"}', '{"method":"initialize"}', "  ", "[1]"]
    out = service.answer_requests(spark.createDataFrame([(x,) for x in lines], "value string"))
    r = F.from_json("response", "id int, result struct<serverInfo:struct<name:string>,tools:array<struct<name:string>>>")
    method = F.when(r["id"] == 1, "initialize").otherwise("tools/list")
    names = F.array_join(F.transform(r["result"]["tools"], lambda t: t["name"]), ", ")
    return out.select(method.alias("method"), r["result"]["serverInfo"]["name"].alias("server"), names.alias("tools"))


# ---- budgets


_SIZES = f"SELECT session_id, id AS seq, o AS light, floor(o / 2)::BIGINT AS medium, floor(o / 4)::BIGINT AS aggressive, {_CAT} AS category FROM ({_EV})"
_PRESSURE = f"CASE WHEN {{used}} / ({_LIMIT}) < 0.5 THEN 'light' WHEN {{used}} / ({_LIMIT}) < 0.8 THEN 'medium' ELSE 'aggressive' END"
_CHOSEN = f"CASE WHEN {{used}} / ({_LIMIT}) < 0.5 THEN light WHEN {{used}} / ({_LIMIT}) < 0.8 THEN medium ELSE aggressive END"


@query(f"""WITH RECURSIVE s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY session_id, category ORDER BY seq, light, medium, aggressive) AS i FROM ({_SIZES})),
 f AS (SELECT session_id, category, seq, i, 0::BIGINT AS before, {_PRESSURE.format(used=0)} AS level, ({_CHOSEN.format(used=0)})::BIGINT AS tokens FROM s WHERE i = 1
 UNION ALL SELECT session_id, category, seq, i, before, {_PRESSURE.format(used='before')}, {_CHOSEN.format(used='before')} FROM (SELECT s.*, f.before + f.tokens AS before FROM f JOIN s ON s.session_id = f.session_id AND s.category = f.category AND s.i = f.i + 1))
 SELECT session_id, category, seq, level, tokens FROM f""")
def budget_feedback(spark, d):
    o = F.col("original_tokens")
    rows = events(spark, d).select("session_id", B.category_of(F.col("content_type")).alias("category"), F.col("id").alias("seq"), o.alias("light"), F.floor(o / 2).alias("medium"), F.floor(o / 4).alias("aggressive"))
    return B.feedback(rows)


@query(f"SELECT session_id, sum(c)::BIGINT AS used, greatest(100000 - sum(c), 0)::BIGINT AS remaining FROM ({_EV}) GROUP BY 1 UNION ALL SELECT 'others', 0, 100000")
def budget_left(spark, d):
    """Tokens used and left of a session's budget; unknown categories do not count."""
    rows = events(spark, d).select("session_id", B.category_of(F.col("content_type")).alias("category"), F.col("compressed_tokens").alias("tokens"))
    other = spark.createDataFrame([("others", "zap", 5)], "session_id string, category string, tokens long")
    return B.used_and_left(rows.unionByName(other))


# ---- bench


_BENCH = f"SELECT id AS engine, content_type, greatest(o, 1) AS original_tokens, c AS compressed_tokens, greatest(o - c, 0) AS tokens_saved, CASE WHEN o > 0 THEN 1 - c::DOUBLE / o::DOUBLE ELSE 0.0 END AS r FROM ({_EV})"
_QUALITY = "CASE WHEN r < 0.05 THEN 70.0 WHEN r > 0.95 THEN 75.0 WHEN r >= 0.3 AND r <= 0.8 THEN 95.0 ELSE 88.0 END::DOUBLE"


def _measured(spark, d) -> DataFrame:
    return events(spark, d).withColumn("name", F.col("id")).withColumn("ratio", T.saved_ratio(F.col("original_tokens"), F.col("compressed_tokens")))


@query(f"SELECT engine, content_type, original_tokens, compressed_tokens, tokens_saved, r * 100 AS savings_pct, {_QUALITY} AS quality_score FROM ({_BENCH})")
def bench_rows(spark, d):
    """Savings and quality of measured texts."""
    return A.bench_rows(_measured(spark, d))


@query(f"SELECT sum(tokens_saved)::BIGINT AS total_saved, round(avg(r * 100), 6) AS avg_savings FROM ({_BENCH})")
def bench_footer(spark, d):
    return A.bench_footer(A.bench_rows(_measured(spark, d))).withColumn("avg_savings", F.round("avg_savings", 6))


@query(f"SELECT engine, printf('%-28s %-14s %7d  %7d  %6.1f%%  %7.1f', engine::VARCHAR, content_type, original_tokens, compressed_tokens, r * 100, {_QUALITY}) AS line FROM ({_BENCH})")
def bench_table(spark, d):
    """The bench rows as lines of text."""
    return A.bench_table(A.bench_rows(_measured(spark, d)))


@query()
def bench_samples(spark, d):
    """The sample texts at every level: sizes, savings, quality (timed runs: samples.timed_samples)."""
    out = None
    for level in L.LEVELS:
        rows = samples.measured_samples(spark, level).withColumn("level", F.lit(level))
        out = rows if out is None else out.unionByName(rows)
    return out


# ---- tokens and SQL functions


VOCABULARY = os.environ.get("TOKENIZER_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_COUNTED = [("hello world", 2), ("", 0), (None, 0), ("The quick brown fox jumps over the lazy dog", 9), (" hello", 1), ("1 2 3", 3)]

if os.path.exists(VOCABULARY):

    @query("SELECT content, tokens::BIGINT AS tokens FROM (" + values(_COUNTED, "content, tokens") + ")")
    def exact_tokens(spark, d):
        """Byte-pair token counts by a given vocabulary."""
        rows = spark.createDataFrame([r[:1] for r in _COUNTED], "content string")
        return rows.select("content", T.exact_tokens(F.col("content"), VOCABULARY, PATTERN).alias("tokens"))


@query(f"""WITH RECURSIVE logs AS (SELECT conv_id, string_agg(role, {NL} ORDER BY turn) AS content FROM conversations GROUP BY 1), {sql_reduced_output('logs', 'conv_id', 'content', 'light')}
 SELECT l.conv_id, i - 1 AS place, line, r.reduced FROM ({sql_lines('logs', 'conv_id', 'content')}) l JOIN reduced_light r ON r.conv_id = l.conv_id""")
def sql_functions(spark, d):
    """Reducers and table functions called from SQL."""
    register(spark)
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    rows.select("conv_id", F.array_join(F.transform("x", lambda e: e["role"]), "\n").alias("content")).createOrReplaceTempView("condensa_logs")
    return spark.sql("SELECT l.conv_id, CAST(t.place AS BIGINT) AS place, t.line, reduce_text(l.content, 'command_output', 'light') AS reduced FROM condensa_logs l, LATERAL text_lines(l.content) t")
