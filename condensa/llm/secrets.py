"""Operator 4 [native]: secret scan by a trigram inverted index.

Each rule's pattern is an alternation of pieces; trigrams of the pieces' mandatory
literals make a Boolean query, an OR of ANDs.  The index holds, for the trigrams
that some rule needs, the documents containing them (lower-cased).  A rule's
candidates are the documents in the intersection of a branch's postings; only
those are verified by the pattern.  Rules whose patterns have no mandatory
trigram scan every text.  All steps are DataFrame functions.

Defined results: null and empty texts have no spans and the digest of no bytes;
repeated rows give equal rows (documents are keyed by two hashes of id and text); spans
are code points, end exclusive, of whole texts of any length; spans of one kind cannot
tie, kinds that start together come as listed; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from condensa.llm._kit import durable, held_join, sized_join
from condensa.llm._spans import listed, match_pieces, spans_of

_ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"


def _assign_value(m: Column) -> Column:
    """Group 2 of an assignment: the run of value characters that ends the match, after its last : or = that is no value."""
    return F.regexp_extract(m, _ASSIGN, 2)


#: kind: (pattern, mandatory literal alternatives, test of a match); the first three are the base kinds.
RULES: dict[str, tuple] = {
    "assign": (_ASSIGN, ["password", "passwd", "secret", "token", "api_?key"], lambda m: F.length(_assign_value(m)) >= 6),
    "access": (r"AKIA[A-Z0-9]+", ["AKIA"], lambda m: F.length(m) >= 20),
    # runs are maximal, so a minimum inside the pattern finds the same runs
    "hex": (r"[0-9a-f]{24,}", [], lambda m: F.length(m) >= 24),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", ["-----BEGIN [A-Z ]*PRIVATE KEY-----"], lambda m: F.lit(True)),
    "github": (r"gh[pousr]_[A-Za-z0-9]{36,}", ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], lambda m: F.lit(True)),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]{10,}", ["xox[abprs]-"], lambda m: F.lit(True)),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", ["eyJ"], lambda m: F.lit(True)),
    "urlauth": (r"[a-z][a-z0-9+]*://[^\s:/@]+:[^\s:/@]+@", ["://"], lambda m: F.lit(True)),
}
BASE = ("assign", "access", "hex")
SPANS = "array<struct<start:bigint,ord:int,end:bigint,kind:string>>"


def literal_runs(piece: str) -> list[str]:
    """Maximal strings that every match of a simple pattern contains: classes and optional letters cut them."""
    piece = re.sub(r"\[[^\]]*\][*+?]?|.[*?]", "\0", piece)
    return [x for x in piece.split("\0") if x]


def trigram_query(alternatives: list[str]) -> list[frozenset[str]]:
    """OR of ANDs of lower-case trigrams; empty if some alternative has no mandatory trigram."""
    out = []
    for alt in alternatives:
        grams = frozenset(r[i : i + 3].lower() for r in literal_runs(alt) for i in range(len(r) - 2))
        if not grams:
            return []
        out.append(grams)
    return out


def _one_of(letters: list[str]) -> str:
    return "[" + "".join("\\" + c if c in "-]\\^[" else c for c in sorted(letters)) + "]"


def trigram_pattern(trigrams: list[str]) -> str:
    """A pattern that matches, without taking a letter, where one of the trigrams stands; group 1 is it."""
    heads: dict[str, dict[str, list[str]]] = {}
    for a, b, c in trigrams:
        heads.setdefault(a, {}).setdefault(b, []).append(c)
    branches = (re.escape(a) + "(?:" + "|".join(re.escape(b) + _one_of(cs) for b, cs in tails.items()) + ")" for a, tails in sorted(heads.items()))
    return f"(?={_one_of(list(heads))})(?=({'|'.join(branches)}))"


def build_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, key) of the given lower-case trigrams, each text read once; docs has key and text."""
    there = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(trigram_pattern(trigrams)), 1))
    return docs.select("key", F.explode(there).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(key, rules): rules whose query the key's postings satisfy, by counting each branch's trigrams."""
    branches = [(rule, n, t, len(b)) for rule, q in queries.items() for n, b in enumerate(q) for t in sorted(b)]
    wanted = index.sparkSession.createDataFrame(branches, "rule string, branch int, trigram string, need int")
    met = index.join(F.broadcast(wanted), "trigram").groupBy("key", "rule", "branch", "need").agg(F.count_distinct("trigram").alias("n")).where("n = need")
    return met.groupBy("key").agg(F.collect_set("rule").alias("rules"))


def find_secrets(docs: DataFrame, rules: dict[str, tuple] = RULES) -> DataFrame:
    """doc_id and spans, array of struct(start, ord, end, kind), of every document.

    Only the texts of candidates meet the candidates' table; their spans come back
    to all documents by key, so no text that holds nothing is shuffled.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text")).withColumn("check", F.xxhash64("text", F.lit(1)))
    queries = {k: q for k, (_, alts, _) in rules.items() if (q := trigram_query(alts))}
    grams = sorted(set(itertools.chain.from_iterable(b for q in queries.values() for b in q)))
    found = durable(candidates(build_index(keyed.select("key", "text"), grams), queries), "secret-candidates")
    order = list(rules)

    def pieces(kinds, asked) -> Column:
        """The pieces of each kind that is asked for and met."""
        def one(k: str) -> Column:
            pattern, _, ok = rules[k]
            got = F.struct(F.lit(order.index(k)).alias("ord"), F.lit(k).alias("kind"), match_pieces(F.col("text"), pattern, ok).alias("pieces"))
            return F.when(asked(k) & F.col("text").rlike(pattern), got)

        return F.explode(F.array_compact(F.array(*map(one, kinds)))).alias("p")

    verified = held_join(keyed.select("key", "check", "text"), found, "key", 48).select("key", "check", pieces(queries, lambda k: F.array_contains("rules", k)))
    scanned = keyed.select("key", "check", pieces([k for k in rules if k not in queries], lambda k: F.lit(True)))
    hits = durable(spans_of(verified.unionByName(scanned).select("key", "check", "p.*"), ["key", "check"]), "secret-spans")
    rows = sized_join(keyed.select("doc_id", "key", "check"), hits, ["key", "check"], "left", 256)
    return rows.select("doc_id", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The counts, the base spans' checksum and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    of_kind = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op4_secrets(spark, sf_dir):
    return digest(find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def _sql_spans(order: int, kind: str, pattern: str, test: str) -> str:
    """SQL: the places of a kind's matches, by the lengths of the matches and of what stands between them."""
    quoted = pattern.replace("'", "''")
    return f"""SELECT r, {order} AS ord, '{kind}' AS kind, p.start_ AS start_, p.start_ + length(m) AS end_ FROM (
 SELECT r, m, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'at': i, 'start_': list_sum(list_transform(rest[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT}})) AS p, unnest(m) AS match
 FROM (SELECT r, regexp_extract_all(text, '{quoted}') AS m, string_split_regex(text, '{quoted}') AS rest FROM d WHERE regexp_matches(text, '{quoted}'))) q(r, m_, p, m) WHERE {test}"""


def _sql() -> str:
    pattern = {k: p for k, (p, _, _) in RULES.items()}
    value = _ASSIGN.replace("'", "''")
    tests = {"assign": f"length(regexp_extract(m, '{value}', 2)) >= 6", "access": "length(m) >= 20"}
    kinds = " UNION ALL ".join(_sql_spans(n, k, p, tests.get(k, "TRUE")) for n, (k, p) in enumerate(pattern.items()))
    text = "kind || ':' || start_ || ':' || end_"
    base = ", ".join(f"'{k}'" for k in BASE)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), s AS ({kinds}),
g AS (SELECT r, {counts}, string_agg({text}, ',' ORDER BY start_, ord) FILTER (kind IN ({base})) AS base, string_agg({text}, ',' ORDER BY start_, ord) AS spans FROM s GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)"""


OP4_SQL = _sql()
