"""Operator 8 [native]: license scan by a positional rare-token index.

Every text is read once: the places of the words that license notices use, with the
few words behind a word that may open a phrase.  Over all documents the document
frequency of each such word is counted, and each notice template is indexed by
(word, position) of its highest-IDF words.  A file's places are looked up in that
index, postings of one template that agree on the relative position are intersected,
and an alignment with enough agreeing words is verified: the template's mandatory key
phrase has to stand there.  Base phrases are taken at every place.  All steps are
DataFrame functions; nothing is capped by a file's length, as all places of an indexed
word are looked up.

Defined results: null and empty texts have 0 words, no labels, score 0 and null
places; repeated rows give equal rows; words of equal IDF are indexed by name, ties
between alignments do not show, as the best share of each label counts; whole texts of
any length are read; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from condensa.llm._kit import durable, sized_join
from condensa.llm._spans import SWAP, bound

#: What separates words once A-Z are lower-cased.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The only other letter whose lower case is an ASCII letter; it is no k here.
KELVIN = "\u212a"
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Fixed values: (label, mandatory key phrase, words of the notice).
TEMPLATES = (
    ("agpl", "affero general public license", "licensed under the gnu affero general public license version 3"),
    ("agpl", "affero general public license", "it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("apache-2.0", "apache license", "licensed under the apache license version 2 0"),
    ("apache-2.0", "apache license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("artistic-2.0", "artistic license", "licensed under the artistic license 2 0"),
    ("boost", "boost software license", "distributed under the boost software license version 1 0"),
    ("bsd", "source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "bsd license", "released under the bsd license"),
    ("cc-by", "cc by", "licensed under cc by 4 0"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("cc0", "waived all copyright", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("creative-commons", "creative commons", "this work is licensed under a creative commons attribution license"),
    ("epl", "eclipse public license", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("gpl", "general public license", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "general public license", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "use copy modify and or", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "lesser general public license", "licensed under the gnu lesser general public license version 3"),
    ("lgpl", "lesser general public license", "it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "mit license", "released under the mit license"),
    ("mit-text", "hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("mpl-2.0", "mozilla public license", "this source code form is subject to the terms of the mozilla public license version 2 0"),
    ("reserved", "rights reserved", "copyright all rights reserved"),
    ("unlicense", "unencumbered software", "this is free and unencumbered software released into the public domain"),
    ("zlib", "without any express or implied", "this software is provided as is without any express or implied warranty"),
)
#: Words that any prose has; they take no part in the index.
COMMON = frozenset("a and any are as at can except for has in into is it made may not of or possible terms that the this to use with without work you 0 1 2 3 4".split())
#: Highest-IDF words that a template is indexed by, agreeing words that make an alignment, their least share as a fraction.
INDEXED, AGREE, SHARE = 8, 2, (2, 3)
#: Words that a key phrase may stand outside of its alignment, and words of the longest phrase behind its first.
NEAR, TAIL = 8, max(len(p.split()) for _, p, _ in TEMPLATES) - 1


def template_postings() -> list[tuple[int, str, str, int]]:
    """(template, label, word, position) of all words that may be indexed."""
    return [(t, label, w, i) for t, (label, _, text) in enumerate(TEMPLATES) for i, w in enumerate(text.split()) if w not in COMMON]


def template_phrases() -> list[tuple[int, str, str, int]]:
    """(template, first word of its key phrase, the words behind it, the template's length)."""
    return [(t, phrase.split()[0], phrase.partition(" ")[2], len(text.split())) for t, (_, phrase, text) in enumerate(TEMPLATES)]


def opens(tail: Column, rest: Column) -> Column:
    """Whether the words behind a place go on with the rest of a phrase."""
    return F.startswith(F.concat(tail, F.lit(" ")), F.concat(rest, F.lit(" ")))


def word_places(text: Column) -> Column:
    """Struct of a text: n (words) and at, the places of template and phrase words as struct(word, pos, tail)."""
    first = sorted({p.split()[0] for p in (*BASE, *(p for _, p, _ in TEMPLATES))})
    vocabulary = sorted({w for _, _, w, _ in template_postings()} | set(first))

    def places(words: Column) -> Column:  # a separator in front or behind leaves an empty word there
        before = F.when(F.get(words, 0) == "", 1).otherwise(0)
        after = F.when((F.size(words) > 1) & (F.get(words, F.size(words) - 1) == ""), 1).otherwise(0)

        def one(word: Column, i: Column) -> Column:
            tail = F.when(word.isin(first), F.array_join(F.slice(words, i + 2, F.lit(TAIL)), " "))
            return F.when(word.isin(vocabulary), F.struct(word.alias("word"), (i - before).alias("pos"), tail.alias("tail")))

        return F.struct((F.size(words) - before - after).cast("long").alias("n"), F.filter(F.transform(words, one), lambda x: x.isNotNull()).alias("at"))

    return bound(F.split(F.lower(F.replace(text, F.lit(KELVIN), F.lit(SWAP))), SEPARATOR), places)


def rare_index(places: DataFrame) -> DataFrame:
    """template, label, word, tpos, of: each template's INDEXED words of the highest IDF over all documents, at all their positions."""
    spark = places.sparkSession
    frequency = places.select(F.explode(F.array_distinct(F.transform("at", lambda x: x["word"]))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    postings = spark.createDataFrame(template_postings(), "template int, label string, word string, tpos int")
    # a word in no document cannot be met; the rarer the word, the higher its IDF
    rank = F.dense_rank().over(Window.partitionBy("template").orderBy("df", "word"))
    rare = postings.join(F.broadcast(frequency), "word").withColumn("r", rank).where(F.col("r") <= INDEXED)  # one row for each template word
    return durable(rare.withColumn("of", F.count("*").over(Window.partitionBy("template"))).select("template", "label", "word", "tpos", "of"), "license-index")


def method_labels(places: DataFrame) -> DataFrame:
    """row, label, share: the labels whose templates align with a document's places and whose key phrases stand there."""
    spark = places.sparkSession
    index = F.broadcast(rare_index(places))  # at most the templates' words
    looked_up = places.select("row", F.explode("at").alias("a")).select("row", "a.*")
    met = looked_up.join(index, "word").select("row", "template", "label", "of", (F.col("pos") - F.col("tpos")).alias("offset"))
    aligned = met.groupBy("row", "template", "label", "of", "offset").agg(F.count("*").alias("n")).where((F.col("n") >= AGREE) & (F.col("n") * SHARE[1] >= F.col("of") * SHARE[0]))
    phrases = spark.createDataFrame(template_phrases(), "template int, word string, rest string, length int")
    wanted = aligned.join(F.broadcast(phrases), "template")
    stands = looked_up.where("tail is not null").select("row", "word", "pos", "tail")
    near = F.col("pos").between(F.col("offset") - NEAR, F.col("offset") + F.col("length") + NEAR)
    verified = wanted.join(stands, ["row", "word"]).where(near & opens(F.col("tail"), F.col("rest")))
    return verified.groupBy("row", "label").agg(F.max(F.col("n") / F.col("of")).alias("share"))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document."""
    found = word_places(F.coalesce("text", F.lit("")))
    places = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", found.alias("x")).select("row", "doc_id", F.col("x.n").alias("n_words"), "x.at")
    places = durable(places, "license-places")
    own = method_labels(places).groupBy("row").agg(F.collect_set("label").alias("own"), F.max("share").alias("best"))
    own = durable(own, "license-own")

    def base(x: Column) -> Column:
        label = None
        for phrase, name in BASE.items():
            word, _, rest = phrase.partition(" ")
            test = (x["word"] == word) & opens(x["tail"], F.lit(rest))
            label = F.when(test, name) if label is None else label.when(test, name)
        return F.struct(x["pos"].alias("pos"), label.alias("label"))

    based = F.filter(F.transform("at", base), lambda x: x["label"].isNotNull())
    rows = sized_join(places.select("row", "doc_id", "n_words", based.alias("base")), own, "row", "left", 96)
    labels, none = F.array_distinct(F.transform("base", lambda x: x["label"])), F.array().cast("array<string>")
    positions = F.transform("base", lambda x: x["pos"].cast("long"))
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return rows.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(positions).alias("first_word"), F.array_max(positions).alias("last_word"), F.array_join(F.array_sort(labels), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(labels, F.coalesce("own", none))), ",").alias("labels"), score.alias("score"))


def op8_licenses(spark, sf_dir):
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    rows = ", ".join(f"({t}, '{label}', '{w}', {i})" for t, label, w, i in template_postings())
    phrases = ", ".join(f"({t}, {p.split()!r}, {len(text.split())})" for t, (_, p, text) in enumerate(TEMPLATES))
    bases = " OR ".join(f"(x.w = '{p.split()[0]}' AND {p.split()!r} = d.w[x.i + 1:x.i + {len(p.split())}])" for p in BASE)
    label = "CASE x.w " + " ".join(f"WHEN '{p.split()[0]}' THEN '{name}'" for p, name in BASE.items()) + " END"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
x AS MATERIALIZED (SELECT r, unnest(w) AS w, unnest(range(len(w))) AS i FROM d),
b AS (SELECT x.r, x.i, {label} AS label FROM x JOIN d ON d.r = x.r WHERE {bases}),
t AS (SELECT * FROM (VALUES {rows}) v(template, label, w, tpos)), q AS (SELECT * FROM (VALUES {phrases}) v(template, phrase, length)),
f AS (SELECT w, count(DISTINCT r) AS df FROM x WHERE w IN (SELECT w FROM t) GROUP BY w),
k AS (SELECT *, dense_rank() OVER (PARTITION BY template ORDER BY df, w) AS rank FROM t JOIN f USING (w)),
ix AS (SELECT *, count(*) OVER (PARTITION BY template) AS of_ FROM k WHERE rank <= {INDEXED}),
al AS (SELECT x.r, ix.template, ix.label, ix.of_, x.i - ix.tpos AS off, count(*) AS n FROM x JOIN ix ON ix.w = x.w GROUP BY ALL HAVING count(*) >= {AGREE} AND count(*) * {SHARE[1]} >= ix.of_ * {SHARE[0]}),
v AS (SELECT DISTINCT al.r, al.label, al.n / al.of_ AS share FROM al JOIN q USING (template) JOIN d ON d.r = al.r WHERE len(list_filter(range(off - {NEAR}, off + length + {NEAR} + 1), lambda p: p >= 0 AND d.w[p + 1:p + len(phrase)] = phrase)) > 0),
g AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS base FROM b GROUP BY r),
o AS (SELECT r, list(DISTINCT label) AS own, max(share) AS best FROM v GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(base, [])), ',') AS base_labels,
 array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(own, [])))), ',') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN g USING (r) LEFT JOIN o USING (r)"""


OP8_SQL = _sql()
