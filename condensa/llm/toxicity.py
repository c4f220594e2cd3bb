"""Operator 5: toxicity by Levenshtein automata intersected with a lexicon trie.

The lexicon is learned: words and word beginnings that separate toxic from other
labelled documents are chosen greedily, each explaining toxic documents that the
ones before it left (a cover), so chance words of copied texts stay out.  The
trie of the lexicon and the Levenshtein automata of its terms run as one lazily
built automaton: a state holds (trie node, edits) pairs, so a word is read once for
all terms.  Each hit's chance of abuse is learned by term and by edits; a window
around the hit tells quotation (quote marks around it, or a reporting word before
it) and lowers it.  The hits of a text combine as independent chances (noisy or).

The fit reads at most FIT_ROWS labelled documents, those of the smallest hashes of
doc_id, and FIT_TOXIC toxic ones.  Their words are read and counted on the executors;
the driver gets the terms in question, FIT_TERMS at most, and for each toxic document
the numbers of those that it holds, so neither its memory nor the model's size depends
on the length of the texts.

Defined results: null and empty texts have the score of a text without hits;
without usable labels, or on empty tables, the lexicon is empty and that score 0;
documents labelled twice count once if the labels agree, else not at all; of texts
that share an id one is learned from; repeated rows score alike; whole texts are read
however long; extra columns are not read, whatever their names.  Ids stay in the JVM.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from condensa.llm._kit import durable, forget, sized_join

FIT_ROWS, FIT_TOXIC = 6_000, 2_000
#: Terms in question that the driver weighs, those of the most toxic documents first.
FIT_TERMS = 5_000
#: Terms that a task counts before it passes their counts on.
COUNT_ROWS = 50_000
THRESHOLD = 0.3
#: Lexicon terms: letters, toxic documents a term must explain, share of its documents that are toxic.
LEAST_LETTERS, LEAST_EXPLAINED, LEAST_SHARE = 4, 3, 0.8
#: Terms of this many letters or more may be misspelled by one edit.
EDIT_LETTERS = 5
#: Words on each side that the quotation window spans, and what is left of a quoted hit's weight.
WINDOW, QUOTED = 6, 0.35
QUOTES = "\"'«»“”„‘’‚"
REPORTING = frozenset("said says called calls quote quoted quotes wrote word words term slur insult sagte nannte wort dit appelé mot dijo llamó palabra".split())
_WORD = re.compile(r"[^\W\d_]+")


class LexiconAutomaton:
    """Deterministic intersection of a trie and the terms' Levenshtein automata.

    terms: {term: whole}; a term that is not whole also matches longer words.
    match(word) gives {(term, edits)} of the best edits of each term.
    """

    def __init__(self, terms: dict[str, bool]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.deep = [0]  # letters of the longest whole term below, for the edits allowed there
        self.whole = dict(terms)
        for t in terms:
            node, letters = 0, len(t) if terms[t] else 0  # a beginning allows no edits
            self.deep[0] = max(self.deep[0], letters)
            for c in t:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.term)
                    self.children.append({})
                    self.term.append(None)
                    self.deep.append(0)
                node = self.children[node][c]
                self.deep[node] = max(self.deep[node], letters)
            self.term[node] = t
        self.start = self._close({(0, 0)})
        self.moves: dict[frozenset, dict[str, frozenset]] = {}
        self.known: dict[str, tuple] = {}

    def _close(self, states: set) -> frozenset:
        """Add the states reached by leaving out letters of a term (a missing letter in the word)."""
        todo = list(states)
        while todo:
            node, e = todo.pop()
            if e == 0:
                for n in self.children[node].values():
                    if self.deep[n] >= EDIT_LETTERS and (n, 1) not in states:
                        states.add((n, 1))
        return frozenset(s for s in states if not (s[1] and (s[0], 0) in states))

    def _step(self, states: frozenset, c: str) -> frozenset:
        out = set()
        for node, e in states:
            n = self.children[node].get(c)
            if n is not None:
                out.add((n, e))
            if e == 0 and self.deep[node] >= EDIT_LETTERS:
                out.add((node, 1))  # an extra letter in the word
                out.update((x, 1) for x in self.children[node].values() if self.deep[x] >= EDIT_LETTERS)
            if e == 0 and self.term[node] is not None and not self.whole[self.term[node]]:
                out.add((node, e))  # a word's end behind a beginning
        return self._close(out)

    def match(self, word: str) -> tuple:
        got = self.known.get(word)
        if got is not None:
            return got
        state = self.start
        for c in word:
            row = self.moves.get(state)
            if row is None:
                row = self.moves.setdefault(state, {})
            nxt = row.get(c)
            if nxt is None:
                nxt = row[c] = self._step(state, c)
            state = nxt
            if not state:
                break
        best: dict[str, int] = {}
        for node, e in state:
            t = self.term[node]
            if t is not None and (e == 0 or (self.whole[t] and len(t) >= EDIT_LETTERS)):
                best[t] = min(e, best.get(t, 9))
        got = tuple(sorted(best.items()))
        if len(self.known) > 200_000:
            self.known.clear()
        self.known[word] = got
        return got


def term_features(words: set[str]) -> set[tuple[str, bool]]:
    """(word, True) and (beginning of a word, False) of a text's words, of LEAST_LETTERS letters or more."""
    whole = {(w, True) for w in words if len(w) >= LEAST_LETTERS}
    return whole | {(w[:k], False) for w in words for k in range(LEAST_LETTERS, min(len(w), 9))}


def learn_lexicon(terms: list[tuple[str, bool]], bad: list[int], good: list[int], held: list[list[int]], n_bad: int) -> dict[str, bool]:
    """Terms (True: whole words) covering the toxic documents.

    terms are those in question, with the numbers of toxic and of other documents
    that hold each; held lists the terms in question of each toxic document.
    """
    where = defaultdict(set)
    for i, numbers in enumerate(held):
        for f in numbers:
            where[f].add(i)
    left, out = set(range(len(held))), {}
    while where:
        # documents explained less those wrongly hit; a beginning must explain a tenth more than a word
        f = max(where, key=lambda f: (len(where[f] & left) * (1.1 if terms[f][1] else 1.0) - 3 * good[f], terms[f][1], len(terms[f][0]), terms[f][0]))
        gain = where[f] & left
        if len(gain) < LEAST_EXPLAINED:
            break
        text, whole = terms[f]
        out[text] = out.get(text, True) and whole
        left -= gain
        where = {g: s for g, s in where.items() if g != f and len(s & left) >= LEAST_EXPLAINED}
    # words that come with chosen terms and never without toxicity are terms as well
    for f, (text, whole) in enumerate(terms):
        if whole and text not in out and not good[f] and bad[f] >= max(8, 0.02 * n_bad) and not any(text.startswith(o) for o, w in out.items() if not w):
            out[text] = True
    return out


def _quoted(text: str, start: int, end: int) -> bool:
    before, after = text[max(0, start - 40) : start], text[end : end + 40]
    if before[-1:] in QUOTES and before[-1:] and after[:1] in QUOTES and after[:1]:
        return True
    return any(w in REPORTING for w in _WORD.findall(before.lower())[-WINDOW:])


class ToxicityModel:
    """Lexicon automaton, chance of abuse by (term, edits), chance without hits."""

    def __init__(self, terms: dict[str, bool], chance: dict, base: float):
        self.terms, self.chance, self.base = terms, chance, base
        self._ready()

    def _ready(self):
        self.auto = LexiconAutomaton(self.terms)
        self.letters = {c for t in self.terms for c in t[:3]}  # one of a word's first two, if an edit at most lies before them

    def state(self) -> tuple:
        """Plain values to broadcast; ToxicityModel(*state) is the model again."""
        return self.terms, self.chance, self.base

    def hits(self, text: str) -> list[tuple[int, int, str, int, bool]]:
        """(start, end, term, edits, quoted) of every word that the automaton accepts."""
        lower = text.lower()
        words = set(_WORD.findall(lower))
        match, letters = self.auto.match, self.letters
        found = {w: m for w in words if (w[0] in letters or w[1:2] in letters) and (m := match(w))}
        if not found:
            return []
        if len(lower) != len(text):  # a letter whose lower case has another length
            text = lower
        return [(x.start(), x.end(), t, e, _quoted(text, x.start(), x.end())) for x in _WORD.finditer(lower) if x.group() in found for t, e in found[x.group()]]

    def score(self, text: str | None) -> float:
        miss, seen = 1.0, set()
        for s, _, t, e, quoted in self.hits(text or ""):
            p = self.chance.get((t, e), 0.0) * (QUOTED if quoted else 1.0)
            if (t, e, quoted) in seen:
                p *= 0.2  # the same word again says little more
            seen.add((t, e, quoted))
            miss *= 1.0 - p
        return float(min(1.0, max(0.0, 1.0 - (1.0 - self.base) * miss)))


def chances(terms: dict[str, bool], counted: dict[tuple[str, int], tuple[int, int]], plain: tuple[int, int]) -> ToxicityModel:
    """The model of a lexicon; counted: (documents, toxic ones) by term and edits; plain: the same of those without a term."""
    chance = {k: y / (n + 1.0) for k, (n, y) in counted.items()}
    for t in terms:  # misspellings that the sample lacks: half of the term's own chance
        if terms[t] and len(t) >= EDIT_LETTERS:
            chance.setdefault((t, 1), chance.get((t, 0), 0.0) / 2)
    return ToxicityModel(terms, chance, min(0.25, plain[1] / max(1, plain[0] + 2)))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_words(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """words, y: the distinct words of the bounded sample's texts, outside the held-out quarter; equal texts count once."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.min("toxic").alias("y"), F.max("toxic").alias("y2")).where("y = y2").where(~held_out(F.col("doc_id")))
    known = durable(known.select(F.col("doc_id").alias("label_id"), (F.col("y") == 1).cast("int").alias("y")).withColumn("o", F.xxhash64("label_id")), "toxic-labels")
    some = known.orderBy("o", "label_id").limit(FIT_ROWS).unionByName(known.where("y = 1").orderBy("o", "label_id").limit(FIT_TOXIC)).select("label_id", "y").distinct()
    some = durable(some, "toxic-sample")

    @F.pandas_udf("array<string>")
    def words(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(set(_WORD.findall(t.lower()))) for t in texts], dtype=object)

    texts = docs.where("text is not null").select("doc_id", "text")
    rows = sized_join(texts, some, F.col("doc_id") == F.col("label_id"), "inner", 16).withColumn("h", F.sha2("text", 256))
    # an id with many texts, and a text with many ids, count once
    rows = rows.groupBy("label_id").agg(F.min(F.struct("h", "text", "y")).alias("x")).select("x.*")
    once = rows.groupBy("h").agg(F.max("y").alias("y"), F.first("text").alias("text"))
    out = durable(once.select(words("text").alias("words"), "y"), "toxic-words")
    forget(known, some)
    return out


def _term_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Toxic and other documents by term, summed up before the shuffle in tables of about COUNT_ROWS terms."""
    bad, good = Counter(), Counter()

    def flush():
        terms = list(bad.keys() | good.keys())
        out = pd.DataFrame(terms, columns=["t", "whole"])
        out["bad"], out["good"] = [bad[t] for t in terms], [good[t] for t in terms]
        bad.clear()
        good.clear()
        return out

    for pdf in batches:
        for words, y in zip(pdf["words"], pdf["y"], strict=True):
            (bad if y else good).update(term_features(set(words)))
            if len(bad) + len(good) > COUNT_ROWS:
                yield flush()
    yield flush()


def fit(sample: DataFrame) -> ToxicityModel:
    """The model of labelled_words; texts are counted on the executors."""
    spark = sample.sparkSession

    each = sample.mapInPandas(_term_counts, "t string, whole boolean, bad long, good long").groupBy("t", "whole").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    asked = each.where((F.col("bad") >= LEAST_EXPLAINED) & (F.col("bad") >= LEAST_SHARE * (F.col("bad") + F.col("good") + 1)))
    found = asked.orderBy(F.desc("bad"), F.desc("whole"), "t").limit(FIT_TERMS).collect()
    asked_terms = [(r["t"], r["whole"]) for r in found]
    sent = spark.sparkContext.broadcast({t: i for i, t in enumerate(asked_terms)})

    @F.pandas_udf("array<int>")
    def numbers(rows: pd.Series) -> pd.Series:
        at = sent.value
        return pd.Series([sorted(at[f] for f in term_features(set(ws)) if f in at) for ws in rows], dtype=object)

    # filtered here: a condition on the function's result would run it twice
    held = [list(r[0]) for r in sample.where("y = 1").select(numbers("words")).toLocalIterator() if r[0]] if found else []
    n_bad = sample.where("y = 1").count()
    terms = learn_lexicon(asked_terms, [r["bad"] for r in found], [r["good"] for r in found], held, n_bad)

    @F.pandas_udf("array<struct<t:string,e:int>>")
    def met(rows: pd.Series) -> pd.Series:
        auto, out = LexiconAutomaton(terms), []
        for ws in rows:
            got = {(t, e) for w in ws for t, e in auto.match(w)}
            # misspellings are judged on texts without a term itself
            out.append([{"t": t, "e": e} for t, e in ({g for g in got if not g[1]} or got)])
        return pd.Series(out, dtype=object)

    rows = sample.select("y", met("words").alias("m"))
    counts = rows.select("y", F.explode_outer("m").alias("m")).groupBy("m").agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect()
    counted = {(r["m"]["t"], r["m"]["e"]): (r["n"], r["y"]) for r in counts if r["m"] is not None}
    plain = next(((r["n"], r["y"]) for r in counts if r["m"] is None), (0, 0))
    return chances(terms, counted, plain)


def scored(docs: DataFrame, labels: DataFrame) -> Column:
    """The score of docs' text, by a model learned from them and the labels."""
    sample = labelled_words(docs, labels)
    model = docs.sparkSession.sparkContext.broadcast(fit(sample).state())

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = ToxicityModel(*model.value)
        for texts in batches:
            yield pd.Series([m.score(t) for t in texts], dtype=np.float64)

    forget(sample)
    return score("text")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored(docs, labels).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_civil(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with their columns."""
    return docs.where(scored(docs, labels) < THRESHOLD)


def op5_toxicity(spark, sf_dir):
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
