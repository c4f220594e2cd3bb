"""Tool events and requests, as tables or streams: JSON lines in, reduced events or responses out; running budgets as state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from condensa import __version__
from condensa.functions.levels import BUDGET_TOTAL, LEVELS, service_level, service_type
from condensa.functions.text import saved_ratio
from condensa.operators.analytics import session_totals
from condensa.operators.budget import category_limit, pressure_step
from condensa.operators.classify import type_of_tool
from condensa.operators.diffs import patch
from condensa.operators.samples import timed_samples
from condensa.sources.store import latest_by_hash, measure, parse_events


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.text(path)


def reduce_events(lines: DataFrame, level: str = "medium") -> DataFrame:
    """Each event's reduced output; a line that is no event comes through unchanged."""
    rows = parse_events(lines)
    text = F.coalesce(F.col("event.tool_output"), F.lit(""))
    rows = rows.select("value", F.col("event").isNotNull().alias("is_event"), F.col("event.tool_name").alias("tool_name"), text.alias("content"))
    rows = rows.withColumn("type_hint", F.when(F.col("is_event"), type_of_tool(F.col("tool_name"), F.col("content"))).otherwise("unknown"))
    out = measure(rows, level)
    return out.withColumn("output", F.when(F.col("is_event"), F.col("compressed")).otherwise(F.col("value")))


def write_batches(stream: DataFrame, out: str, checkpoint: str):
    """Append every micro-batch to a Parquet folder until the input is used up."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)


#: Arguments that the calls take; each is a string or absent.
ARGUMENTS = ("content", "type", "level", "hash", "session_id")
_TEXT, _LEVEL = {"type": "string"}, {"type": "string", "enum": list(LEVELS)}
#: name: (what a call does, its arguments, those it must have)
TOOLS = {
    "compress": ("Reduce a text and keep its original by hash.", {"content": _TEXT, "type": {"type": "string", "enum": ["code", "output", "conversation", "json", "mcp"]}, "level": _LEVEL}, ["content"]),
    "expand": ("Give the original text of a hash.", {"hash": _TEXT}, ["hash"]),
    "stats": ("Sum up a session's reductions.", {"session_id": _TEXT}, []),
    "bench": ("Measure the reducers on the sample texts.", {"level": _LEVEL}, []),
    "diff": ("Show what reducing changed, with sizes.", {"hash": _TEXT}, ["hash"]),
}


def tool_list() -> str:
    """The calls' descriptions as JSON."""
    described = [{"name": n, "description": text, "inputSchema": {"type": "object", "properties": props} | ({"required": must} if must else {})} for n, (text, props, must) in TOOLS.items()]
    return json.dumps({"tools": described})


def parse_request(line: str) -> dict:
    """State (bad, silent or open), raw id, method, tool and arguments of a request line."""
    try:
        value = json.loads(line, parse_constant=_no_number)
    except (ValueError, RecursionError):
        return {"state": "bad", "id": "null"}
    if not isinstance(value, dict) or "id" not in value:
        return {"state": "silent"}
    text = lambda x: x if isinstance(x, str) else None
    params = value.get("params") if isinstance(value.get("params"), dict) else {}
    given = params.get("arguments") if isinstance(params.get("arguments"), dict) else {}
    return {"state": "open", "id": json.dumps(value["id"]), "method": text(value.get("method")) or "", "tool": text(params.get("name")) or ""} | {k: text(given.get(k)) for k in ARGUMENTS}


def _no_number(_):
    raise ValueError("no JSON number")


def parsed(value: Column) -> Column:
    @F.pandas_udf("state string, id string, method string, tool string, " + ", ".join(f"{k} string" for k in ARGUMENTS))
    def run(lines: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_request(x) for x in lines], columns=["state", "id", "method", "tool", *ARGUMENTS], dtype=object)

    return run(value)


def pretty(value: Column) -> Column:
    """JSON text with line breaks and two spaces for each depth."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.dumps(json.loads(t), indent=2, ensure_ascii=False) if t is not None else None)

    return run(value)


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    framed = F.to_json(F.struct(text.alias("t")))
    return F.substring(framed, 6, F.length(framed) - 6)


def service_types() -> Column:
    """Map of the type names that calls may give; convers is an older short form."""
    names = {n: service_type(n) for n in ("code", "output", "conversation", "json", "mcp")} | {"convers": service_type("conversation")}
    return F.create_map(*(F.lit(x) for pair in names.items() for x in pair))


def service_levels() -> Column:
    """Map of the level names that calls may give."""
    return F.create_map(*(F.lit(x) for v in LEVELS for x in (v, service_level(v))))


STORE = "id long, session_id string, content_type string, original_hash string, original string, compressed string, original_tokens long, compressed_tokens long"


def answer_requests(requests: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """JSON-RPC request lines (value) to response lines; notifications and blank lines get none, broken lines an error.

    store holds the events that expand, diff and stats read; requests may be a stream, which
    joins it as it stands.  A line's id comes back as it was written: text, number or null.
    """
    spark = requests.sparkSession
    store = spark.createDataFrame([], STORE) if store is None else store
    lines = requests.where(F.length(F.trim("value")) > 0)
    r = lines.select(parsed(F.col("value")).alias("r")).select("r.*").where("state <> 'silent'")
    called = lambda name: (F.col("method") == "tools/call") & (F.col("tool") == name)
    # compress: a text that no call asks for stays null and is not read
    level = F.coalesce(service_levels()[F.col("level")], F.lit("medium"))
    kind = F.when(F.col("type").isNotNull(), F.coalesce(service_types()[F.col("type")], F.lit("unknown")))
    r = measure(r.withColumn("level", level).withColumn("type_hint", kind).withColumn("content", F.when(called("compress"), F.col("content"))))
    squeezed = F.to_json(F.struct("compressed", "compressed_tokens", "content_type", F.col("original_hash").alias("hash"), "original_tokens", F.format_string("%.1f%%", F.col("ratio") * 100).alias("ratio")))
    r = r.withColumn("squeezed", F.when(F.col("content").isNotNull(), squeezed)).select("state", "id", "method", "tool", "hash", "level", "squeezed", F.coalesce("session_id", F.lit("current")).alias("session_id"))
    # expand and diff: the newest event of a hash; stats: the totals of a session
    newest = latest_by_hash(store, "original", "compressed", "content_type", "original_tokens", "compressed_tokens").withColumnRenamed("original_hash", "hash")
    saved = saved_ratio(F.col("original_tokens"), F.col("compressed_tokens")) * 100
    report = F.to_json(F.struct("hash", patch(F.col("original"), F.col("compressed")).alias("unified_diff"), F.octet_length("original").alias("original_bytes"), F.octet_length("compressed").alias("compressed_bytes"), "original_tokens", "compressed_tokens", saved.alias("savings_pct"), "content_type"))
    r = r.join(newest.select("hash", F.col("original").alias("known"), report.alias("report")), "hash", "left")
    totals = session_totals(store)
    types = F.transform("by_type", lambda t: F.struct(t["content_type"].alias("content_type"), t["original_tokens"].alias("original_tokens"), t["compressed_tokens"].alias("compressed_tokens"), t["ratio"].alias("ratio"), t["n"].alias("count")))
    names = [F.col("original_tokens").alias("total_original_tokens"), F.col("compressed_tokens").alias("total_compressed_tokens"), "tokens_saved", F.col("ratio").alias("overall_ratio"), F.col("n").alias("compressions_count"), types.alias("by_type")]
    r = r.join(totals.select("session_id", F.to_json(F.struct("session_id", *names)).alias("totals")), "session_id", "left")
    none = F.concat(F.lit('{"session_id":'), quoted(F.col("session_id")), F.lit(',"total_original_tokens":0,"total_compressed_tokens":0,"tokens_saved":0,"overall_ratio":0.0,"compressions_count":0,"by_type":[]}'))
    bench = F.create_map(*(F.lit(x) for v in LEVELS for x in (v, json.dumps(timed_samples(v)))))
    missing = lambda field: F.lit(f"Missing required field: {field}")
    by_hash = lambda got: F.when(F.col("hash").isNull(), missing("hash")).otherwise(F.coalesce(got, F.concat(F.lit("content not found for hash "), F.col("hash"))))
    text = F.when(called("compress"), F.coalesce(pretty(F.col("squeezed")), missing("content"))).when(called("expand"), by_hash(F.col("known"))).when(called("diff"), by_hash(pretty(F.col("report"))))
    text = text.when(called("stats"), pretty(F.coalesce("totals", none))).when(called("bench"), bench[F.col("level")]).otherwise(F.concat(F.lit("Unknown tool: "), F.col("tool")))
    failed = F.when(called("compress"), F.col("squeezed").isNull()).when(called("expand"), F.col("known").isNull()).when(called("diff"), F.col("report").isNull()).otherwise(~F.col("tool").isin("stats", "bench"))
    content = F.concat(F.lit('{"content":[{"type":"text","text":'), quoted(text), F.lit('}],"isError":'), failed.cast("string"), F.lit("}"))
    hello = F.lit(json.dumps({"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "condensa", "version": __version__}}))
    result = F.when(F.col("method") == "ping", F.lit("{}")).when(F.col("method") == "initialize", hello).when(F.col("method") == "tools/list", F.lit(tool_list())).when(F.col("method") == "tools/call", content)
    unknown = F.concat(F.lit('"error":{"code":-32601,"message":'), quoted(F.concat(F.lit("Method not found: "), F.col("method"))), F.lit("}"))
    outcome = F.when(F.col("state") == "bad", F.lit('"error":{"code":-32700,"message":"Parse error"}')).otherwise(F.coalesce(F.concat(F.lit('"result":'), result), unknown))
    return r.select(F.concat(F.lit('{"jsonrpc":"2.0","id":'), F.col("id"), F.lit(","), outcome, F.lit("}")).alias("response"))


def running_budgets(events: DataFrame, total: int = BUDGET_TOTAL) -> DataFrame:
    """Level of each streamed event (session_id, category, seq, light, medium, aggressive) by its category's state."""

    def update(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        limit = category_limit(key[1], total)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        out = []
        for r in rows.itertuples():
            level = LEVELS[pressure_step(used, limit)]
            used += int(getattr(r, level))
            out.append((key[0], key[1], int(r.seq), level, used))
        state.update((used,))
        yield pd.DataFrame(out, columns=["session_id", "category", "seq", "level", "used"])

    return events.groupBy("session_id", "category").applyInPandasWithState(update, "session_id string, category string, seq long, level string, used long", "used long", "append", "NoTimeout")


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension: tumbling event-time counts with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"))
