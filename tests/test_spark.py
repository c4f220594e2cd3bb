"""Native columns, streams and the catalogue against DuckDB."""

import hashlib
import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from condensa.functions import text as T
from condensa.operators import budget, classify, diffs, reducers
from condensa.plans import catalogue, reductions, requests  # noqa: F401
from condensa.sources import store
from condensa.streaming import service

DATA = "/root/testdata/sf0.001"


def test_columns(spark):
    df = spark.createDataFrame([("a\r\nb\n",), ("",), ("aé😀b",)], "s string")
    assert [r[0] for r in df.select(T.lines(F.col("s"))).collect()] == [["a", "b"], [], ["aé😀b"]]
    assert df.select(T.cut_bytes(F.col("s"), 4)).collect()[2][0] == "aé..."
    assert [r[0] for r in df.select(T.estimated_tokens(F.col("s"))).collect()] == [2, 0, 3]


@pytest.mark.parametrize(("text", "kind"), [("short", "unknown"), ("[1,2,3,4,5]", "json"), ("costs $5 today", "command_output"), ("pub fn x() {}", "code:rust"), ("User: hi\nAI: yo", "conversation"), ('{"name":"x","input_schema":{}}', "mcp_schema")])
def test_types(spark, text, kind):
    assert spark.createDataFrame([(text,)], "s string").select(classify.content_type(F.col("s"))).first()[0] == kind


def test_full_operators(spark, tmp_path):
    """Signals that the given tables do not hold, against the row functions."""
    texts = ['{"a": [1, 2, 3], "b": null}', '{"name":"x","input_schema":{}}', "  [1,2,3,4,5]", "{broken json text", "plain words of a text", None]
    spark.createDataFrame([(4 * i + 3, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = ["json", "mcp_schema", "json", "unknown", "unknown"]
    for name in ("detect_type", "route_by_tool"):
        got = {r["doc_id"]: r["content_type"] for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()}
        assert [got[4 * i + 3] for i in range(5)] == want
    turns = ["hi", "```x```", "I'll do it", "Let's see", "src\\src\\a", "a.rs error", "``` I'll fix a.py: error", None]
    spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(turns)], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["turn"]: r["score"] for r in catalogue.QUERIES["turn_scores"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx({i: reducers.turn_score(t or "", i, len(turns)) for i, t in enumerate(turns)}) and got[6] == 1.0


def test_diff_encoding(spark):
    df = spark.createDataFrame([("a" * 64, "x\ny")], "h string, d string").withColumn("e", diffs.encode(F.col("h"), F.col("d")))
    assert tuple(df.select(diffs.parse_encoded(F.col("e"))).first()[0]) == ("a" * 64, "x\ny")


def test_best_diffs(spark, monkeypatch):
    """Against brute force, over the ends of blocks, in a session without a name, and with texts that are null or empty; no text is broadcast."""
    monkeypatch.setattr(diffs, "BLOCK", 30)
    rng = random.Random(5)
    items, text = [], [f"line {i} of a text that grows é" for i in range(12)]
    for seq in range(100):
        text = text[:]
        for _ in range(rng.randint(0, 2)):
            text[rng.randrange(len(text))] = f"  changed {rng.randrange(9)}"
        items += [(name, seq, rng.choice([None, "", " \n"]) if rng.random() < 0.2 else "\n".join(text if name else text[::-1])) for name in ("s", None)]
    want = {}
    for name, seq, new in items:
        tried = []
        for other, at, base in items:
            if other != name or not seq - diffs.LOOK_BACK <= at < seq or not new or base is None:
                continue
            a, b = ({x.strip() for x in t.split("\n")} - {""} for t in (base, new))
            patch = diffs.make_patch(base, new)
            if (len(a & b) / len(a | b) if a | b else 1) >= diffs.LEAST_JACCARD:
                tried.append((1 - len(patch.encode()) / len(new.encode()), at, hashlib.sha256(base.encode()).hexdigest(), patch))
        if tried and max(tried)[0] > diffs.LEAST_SAVED:
            want[name, seq] = max(tried)[1:]
    found = diffs.best_diffs(spark.createDataFrame(items, "session_id string, seq long, content string").repartition(3))
    got = {(r["session_id"], r["seq"]): (r["base_seq"], r["base_hash"], r["diff_text"]) for r in found.collect()}
    assert got == want and len({at for at, _, _ in got.values()}) > 30 and any(name is None for name, _ in got)
    plan = catalogue.QUERIES["diff_best"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("Exchange") == 2


def test_diff_reconstruct(spark, tmp_path):
    """Every patched text again, rows without a brand too; no original is broadcast."""
    rows = [(i, None if i % 5 == 0 else f"Brand#{i % 2}") for i in range(60)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    found = catalogue.QUERIES["diff_reconstruct"](spark, str(tmp_path))
    text = lambda seq: "\n".join([*reductions._COMMON, f"row {seq:06}"])
    want = {(b, seq, hashlib.sha256(text(seq).encode()).hexdigest()) for b, n in ((None, 12), ("Brand#0", 24), ("Brand#1", 24)) for seq in range(2, n + 1)}
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_limits(spark):
    df = spark.createDataFrame([(c,) for c in ("conversation", "tool_output", "code", "mcp")], "c string")
    assert [r[0] for r in df.select(budget.limit_for(F.col("c"))).collect()] == [40000, 30000, 20000, 10000]


def test_store_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "s", "hello there, world"), (2, "s", "hello there, world")], "id long, session_id string, content string")
    store.append(store.measure(rows), str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    got = store.expand(table, table.select("original_hash").distinct()).collect()
    assert [r["original"] for r in got] == ["hello there, world"]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    event = {"tool_name": "Bash", "tool_input": {}, "tool_output": "a\na\na"}
    (tmp_path / "in/x.txt").write_text(json.dumps(event) + "\n\nnot json\n")
    q = service.write_batches(service.reduce_events(service.read_lines(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    out = {r["output"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out == {"a\n[... 3 similar lines]", "not json"}


def test_requests(spark):
    lines = ['{"id":"1","method":"ping"}', '{"id":"a\\"b","method":"zap"}', "{broken", '{"method":"note"}', '{"id":null,"method":"ping"}', '{"id":[1,"x"],"method":"ping"}', " ", "[1]"]
    got = [json.loads(r[0]) for r in service.answer_requests(spark.createDataFrame([(x,) for x in lines], "value string")).collect()]
    assert sorted(map(str, (r.get("error", {}).get("code") for r in got))) == ["-32601", "-32700", "None", "None", "None"]
    assert sorted(map(str, (r["id"] for r in got if "result" in r))) == ["1", "None", "[1, 'x']"] and 'a"b' in [r["id"] for r in got]


def test_request_stream(spark, tmp_path):
    """Requests as a stream that joins a store as it stands."""
    store = store_of(spark, ["hello\nhello\nhello"])
    key = store.first()["original_hash"]
    call = lambda i, name, **args: json.dumps({"id": i, "method": "tools/call", "params": {"name": name, "arguments": args}})
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.txt").write_text("\n".join([call(1, "expand", hash=key), call(2, "stats", session_id="s"), call(3, "bench", level="light"), call(4, "compress", content="a b c d e f", type="output")]))
    q = service.write_batches(service.answer_requests(service.read_lines(spark, str(tmp_path / "in")), store), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = {r["id"]: r["result"] for r in (json.loads(x[0]) for x in spark.read.parquet(str(tmp_path / "out")).collect())}
    text = lambda i: got[i]["content"][0]["text"]
    assert text(1) == "hello\nhello\nhello" and json.loads(text(2))["compressions_count"] == 1
    assert len(json.loads(text(3))) == 7 and json.loads(text(4))["compressed"] == "a b c d e f"


def store_of(spark, texts):
    rows = spark.createDataFrame([(i, "s", t, "command_output") for i, t in enumerate(texts)], "id long, session_id string, content string, type_hint string")
    return store.measure(rows).withColumnRenamed("content", "original")


def test_budget_streams(spark, tmp_path):
    """Running budgets as state agree with the fold over the whole table; windows count events."""
    rows = [("s", c, i, 9000 + i, 4000, 1000) for i in range(30) for c in ("code", "conversation")]
    names = "session_id string, category string, seq long, light long, medium long, aggressive long"
    df = spark.createDataFrame(rows, names)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = service.running_budgets(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    service.write_batches(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = {(r["category"], r["seq"]): r["level"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r["category"], r["seq"]): r["level"] for r in budget.feedback(df).collect()} and set(got.values()) == {"light", "medium", "aggressive"}
    events = spark.read.parquet(f"{DATA}/events.parquet")
    batch = service.windowed_counts(events).agg(F.sum("n")).first()[0]
    assert batch == events.count()


def test_store_codec(spark, tmp_path):
    import pyarrow.parquet as pq

    store.append(store_of(spark, ["a text"]).withColumnRenamed("original", "content"), str(tmp_path / "t"))
    part = next((tmp_path / "t").rglob("*.parquet"))
    assert pq.ParquetFile(part).metadata.row_group(0).column(0).compression == "ZSTD"


def test_two_forms_agree(spark):
    """Native columns and the row functions of the reducers."""
    texts = ["", "a", "aé😀b" * 40, "x" * 99 + "é", "\x1b[31mred\x1b]0;t\x07 x\x1b[0m", "a\r\nb\r\n", "  pad\t", "\n\n"]
    df = spark.createDataFrame([(i, t, texts[-1 - i]) for i, t in enumerate(texts)], "i int, a string, b string").orderBy("i")
    rows = df.select(T.cut_bytes(F.col("a"), 100), T.strip_ansi(F.col("a")), T.lines(F.col("a")), T.line_similarity(F.col("a"), F.col("b")), T.shorter_trimmed(F.col("a"), 3)).collect()
    for t, other, (cut, plain, lines, alike, short) in zip(texts, texts[::-1], rows, strict=True):
        assert (cut, plain, lines) == (reducers.cut_bytes(t, 100), reducers._ANSI.sub("", t), reducers.split_lines(t))
        assert alike == pytest.approx(reducers.similarity(t, other)) and short == (len(t.strip().encode()) < 3)


def test_samples(spark):
    from condensa.operators import samples

    rows = samples.timed_samples("aggressive")
    table = {r["engine"]: r for r in samples.measured_samples(spark, "aggressive").collect()}
    assert [r["engine"] for r in rows] == [n for n, _, _ in samples.sample_texts()] and len(rows) == 7
    for r in rows:
        same = table[r["engine"]]
        assert (r["original_tokens"], r["compressed_tokens"], r["tokens_saved"], r["quality_score"]) == (same["original_tokens"], same["compressed_tokens"], same["tokens_saved"], same["quality_score"])
        assert r["median_ns"] > 0 and r["ns_per_token"] == pytest.approx(r["median_ns"] / r["original_tokens"])


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in "nation part supplier orders lineitem events documents pages conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    got, want = catalogue.QUERIES[name](spark, DATA).toPandas(), con.execute(catalogue.ORACLES[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    key = lambda rows: sorted(map(repr, rows))
    norm = lambda df: key([tuple(round(float(v), 9) if isinstance(v, int | float) and not isinstance(v, bool) else str(v) for v in r) for r in df[cols].astype(object).where(df[cols].notna(), None).values.tolist()])
    assert norm(got) == norm(want)
