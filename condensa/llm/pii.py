"""Operator 9: personal data by a semi-Markov conditional random field.

Fixed patterns give the base spans (email, ip, card, phone).  Around every place
with a trigger (a digit, an at sign, a title or a word that introduces a name) the line is
cut into tokens, and every run of at most MAX_TOKENS tokens that holds one of the former
or is introduced by the latter is a candidate segment of each type, scored by features of the whole span: its shape, lengths and digit counts,
checksums, octet ranges, capitals, and the words in front of it.  A bounded dynamic
program picks the best segmentation, boundaries and types together.  The field is
log-linear over segmentations: forward and backward sums over segments give the
expected features, and the likelihood of generated lines with known spans is climbed
step by step (AdaGrad).  What the field finds outside the base spans is added; base spans
always stay.

Defined results: null and empty texts have no spans and the digest of no bytes;
texts of any length are read whole, line by line, lines in windows of tokens around
the triggers only, so wide that every candidate holding a trigger lies within one; ties
between segmentations go to the one with fewer spans, then the earlier kind; repeated rows
give equal rows; an empty table gives no rows; other columns are not read.  Spans are
code-point offsets, end exclusive; ids stay in the JVM.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "person", "address")
#: Most tokens of a candidate, and tokens kept on each side of a trigger.
MAX_TOKENS = 8
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match starts with a run of digits and takes each run whole, so none is read twice.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\w\s]|_")
_TITLES = frozenset("mr mrs ms dr prof herr frau monsieur madame señor señora".split())
_PARTICLES = frozenset("de del der la le van von zu".split())
_STREETS = frozenset("street st avenue ave road rd lane drive boulevard straße strasse rue calle platz".split())
#: Words that introduce a name.
_CUES = frozenset("name contact signed sincerely regards attention".split())
_TRIGGER = re.compile(r"[0-9@]|\b(?:" + "|".join(sorted(_TITLES | _CUES)) + r")\b", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[str, int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, leftmost and non-overlapping per kind, failing matches dropped."""
    out = _emails(text) if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(int(x[-10:]) <= 255 and len(x.lstrip("0")) <= 3 for x in m.group().split("."))]
        out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 12 <= len(d := re.sub("[^0-9]", "", m.group())) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def listed(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


# ---- the field


def _iban(s: str) -> bool:
    s = re.sub(r"\s", "", s).upper()
    return bool(re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", s)) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _shape(s: str) -> str:
    s = re.sub(r"[^\W\d_]+", lambda m: "Aa" if m.group()[0].isupper() and m.group()[1:].islower() else "A" if m.group().isupper() else "a", s)
    s = re.sub(r"[0-9]+", lambda m: f"9{min(len(m.group()), 6)}", s)
    return re.sub(r"(?:Aa?[ -]|a )+(?=A)", "W+", s)[:24]  # capital words in a row look alike, however many


def _features(span: str, before: str, earlier: str) -> list[str]:
    """Features of a whole candidate segment and the two words before it."""
    digits = re.sub("[^0-9]", "", span)
    out = [f"shape={_shape(span)}", f"before={before}", f"earlier={earlier}", f"digits={min(len(digits), 20)}", f"words={min(len(span.split()), 5)}"]
    if "@" in span:
        out.append("email" if re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", span) else "at")
    if _IP.fullmatch(span):
        out.append("octets" if all(len(x) <= 3 and int(x) <= 255 for x in span.split(".")) else "dotted")
    if 12 <= len(digits) <= 19 and _CARD.fullmatch(span):
        out.append("luhn" if luhn(digits) else "noluhn")
    if _PHONE.fullmatch(span) and 9 <= len(digits) <= 15:
        out.append("dial")
    if re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", span):
        out.append("ssn")
    if _iban(span):
        out.append("mod97")
    words = re.findall(r"[^\W\d_]+", span)
    capital = bool(words) and all(w[0].isupper() or w.lower() in _PARTICLES for w in words)
    if words and not digits:
        titled = words[0].lower() in _TITLES
        rest = words[1:] if titled else words
        tidy = bool(re.fullmatch(r"[^\W\d_]+\.?(?:[ -][^\W\d_]+)*", span))
        out.append(f"name={titled:d}{capital:d}{tidy:d}{min(len(rest), 3)}{bool(rest) and rest[-1][0].isupper():d}")
        if before in _CUES or earlier in _CUES:
            out.append(f"introduced={capital:d}{tidy:d}{min(len(rest), 3)}")
    if words and digits and words[-1].lower() in _STREETS:
        out.append(f"street={capital:d}{span[0].isdigit():d}{len(words) > 1:d}")
    return out


class Field:
    """Weights by feature name: one number for each kind."""

    def __init__(self, weights: dict[str, list[float]], bias: list[float]):
        self.weights, self.bias, self.known = weights, bias, {}

    def scores(self, span: str, before: str, earlier: str) -> tuple[float, int]:
        """(best score, its kind) of a candidate segment."""
        got = self.known.get((span, before, earlier))
        if got is None:
            rows = [w for f in _features(span, before, earlier) if (w := self.weights.get(f)) is not None]
            sums = [sum(x) for x in zip(self.bias, *rows, strict=True)]
            best = max(sums)
            if len(self.known) > 100_000:
                self.known.clear()
            got = self.known[span, before, earlier] = best, sums.index(best)
        return got


def _word_before(text: str, tokens: list[tuple[int, int]], i: int) -> str:
    return text[tokens[i][0] : tokens[i][1]].lower() if i >= 0 else ""


def _context(text: str, tokens: list[tuple[int, int]], i: int) -> tuple[str, str]:
    """The words before token i, marks left out: the last one and the one before it."""
    words = [w for k in range(i - 1, max(-1, i - 6), -1) if (w := _word_before(text, tokens, k)).isalnum()][:2]
    return (*words, "", "")[:2]


_HOT = re.compile(r"[0-9@]")


def segment(field: Field, text: str, tokens: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Best segmentation of a token run: bounded-entity dynamic programming over (end, length, type).

    Candidates are the runs that hold a digit, an at sign or a title, and those that a cue introduces.
    """
    n = len(tokens)
    score, back = [0.0] * (n + 1), [None] * (n + 1)
    before = [_context(text, tokens, i) for i in range(n)]
    last, hot = -1, []  # the last token of note at or before each token
    for i, (a, b) in enumerate(tokens):
        word = text[a:b]
        if _HOT.match(word) or word.lower() in _TITLES:
            last = i
        hot.append(last)
    led = [x in _CUES or y in _CUES for x, y in before]
    for j in range(1, n + 1):
        score[j], back[j] = score[j - 1], (j - 1, None)
        for i in range(max(0, j - MAX_TOKENS), j):
            if i > hot[j - 1] and not led[i]:
                continue
            s, kind = field.scores(text[tokens[i][0] : tokens[j - 1][1]], *before[i])
            s += score[i]
            if s > score[j]:
                score[j], back[j] = s, (i, kind)
    out, j = [], n
    while j:
        i, kind = back[j]
        if kind is not None:
            out.append((KINDS[kind], tokens[i][0], tokens[j - 1][1]))
        j = i
    return out[::-1]


def _made_sentence(rng: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A generated line with known spans."""
    word = lambda: "".join(rng.choice(["an", "er", "th", "on", "re", "ti", "le", "qu"]) for _ in range(rng.randint(1, 3)))
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    given = lambda: word().title() + (f"-{word().title()}" if rng.random() < 0.2 else "")
    name = lambda: " ".join([given(), *rng.choice([[], [], [], [given()], ["von"], ["de", "la"], ["von", "der"], ["van"]]), given()])

    def card():
        while not luhn(d := num(16)):
            pass
        return rng.choice([d, f"{d[:4]} {d[4:8]} {d[8:12]} {d[12:]}", f"{d[:4]}-{d[4:8]}-{d[8:12]}-{d[12:]}"])

    def iban():
        body, land = num(18), rng.choice(["DE", "FR", "ES", "GB"])
        code = "".join(str(int(c, 36)) for c in land)
        rest = 98 - int(body + code + "00") % 97
        flat = f"{land}{rest:02d}{body}"
        return rng.choice([flat, flat, " ".join(flat[i : i + 4] for i in range(0, len(flat), 4))])

    make = {
        "email": lambda: f"{word()}.{num(2)}@{word()}{num(1)}.example.{rng.choice(['com', 'org'])}",
        "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: rng.choice([f"+{rng.randint(1, 99)} ({num(3)}) {num(3)}-{num(4)}", f"+{rng.randint(1, 99)} {num(3)} {num(4)} {num(3)}", f"+{num(11)}"]),
        "iban": iban,
        "ssn": lambda: f"{num(3)}-{num(2)}-{num(4)}",
        "person": lambda: f"{rng.choice(['Mr', 'Mrs', 'Ms', 'Dr', 'Prof', 'Herr', 'Frau', 'Madame'])}{rng.choice(['.', ''])} {rng.choice([name, lambda: word().title()])()}",
        "address": lambda: f"{rng.randint(1, 999)} {' '.join(word().title() for _ in range(rng.choice([1, 1, 1, 2, 2, 3, 4, 5, 6])))} {rng.choice(sorted(_STREETS)).title()}",
        None: lambda: rng.choice([num(rng.randint(1, 12)), f"{num(4)}-{num(2)}-{num(2)}", f"{num(1)}.{num(1)}", f"version {num(1)}.{num(1)}.{num(1)}", f"{num(3)}.{num(3)}.999.{num(2)}", "Dr", f"@{word()}", f"{rng.randint(1900, 2030)}", f"{num(2)} {word().title()}", word().title(), name(), f"the {rng.choice(sorted(_CUES))} of", f"{rng.choice(sorted(_CUES))} {word()} {word()}", f"{word()} {rng.choice(sorted(_STREETS))}"]),
    }
    cue = {"card": ["card", "paid with"], "phone": ["call", "phone"], "iban": ["iban", "account"], "ssn": ["ssn", "number"], "email": ["mail", "write to"], "ip": ["host", "from"], "address": ["at", "lives at"], "person": ["by", "dear"]}
    text, spans = word().capitalize(), []
    for _ in range(rng.randint(1, 3)):
        kind = rng.choice([*KINDS, None, None, None])
        text += " " + " ".join(word() for _ in range(rng.randint(1, 4))) + " "
        piece = make[kind]()
        if kind == "person" and rng.random() < 0.4:  # an introduced name needs no title
            text += rng.choice(sorted(_CUES)) + rng.choice([" ", ": ", ", "])
            piece = name()
        elif kind and rng.random() < 0.3:
            text += rng.choice(cue[kind]) + rng.choice([" ", ": "])
        if kind:
            spans.append((kind, len(text), len(text) + len(piece)))
        text += piece
    return text + rng.choice([" " + word() + ".", ".", ", " + word()]), spans


class _Lattice:
    """A line's candidate segments with their features, and which of them its known spans are."""

    def __init__(self, text: str, gold: list[tuple[str, int, int]], number: dict[str, int], grow: bool):
        tokens = token_spans(text)
        self.n = len(tokens)
        first, last = {a: i for i, (a, _) in enumerate(tokens)}, {b: i for i, (_, b) in enumerate(tokens)}
        self.segments = [(i, j) for j in range(1, self.n + 1) for i in range(max(0, j - MAX_TOKENS), j)]
        at = {x: k for k, x in enumerate(self.segments)}
        self.gold = [(at[first[a], last[b] + 1], KINDS.index(kind)) for kind, a, b in gold if (first.get(a), last.get(b, -2) + 1) in at]
        rows, features = [], []
        for k, (i, j) in enumerate(self.segments):
            for f in _features(text[tokens[i][0] : tokens[j - 1][1]], *_context(text, tokens, i)):
                if grow:
                    number.setdefault(f, len(number))
                if f in number:
                    rows.append(k)
                    features.append(number[f])
        self.rows, self.features = np.array(rows, np.int64), np.array(features, np.int64)

    def expected(self, w: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """Segments x kinds: the field's chance that a segmentation has this segment as this kind."""
        score = np.broadcast_to(bias, (len(self.segments), len(bias))).copy()
        np.add.at(score, self.rows, w[self.features])
        top = score.max(axis=1)
        each = top + np.log(np.exp(score - top[:, None]).sum(axis=1))
        ahead, behind = np.full(self.n + 1, -np.inf), np.full(self.n + 1, -np.inf)
        ahead[0] = behind[self.n] = 0.0
        for k, (i, j) in enumerate(self.segments):  # by rising end
            if k == 0 or self.segments[k - 1][1] != j:
                ahead[j] = np.logaddexp(ahead[j], ahead[j - 1])  # a token of no span
            ahead[j] = np.logaddexp(ahead[j], ahead[i] + each[k])
        for j in range(self.n, 0, -1):
            behind[j - 1] = np.logaddexp(behind[j - 1], behind[j])
            lo = max(0, j - MAX_TOKENS)
            k = self.first(j)
            behind[lo:j] = np.logaddexp(behind[lo:j], behind[j] + each[k : k + j - lo])
        i, j = np.array(self.segments).T
        return np.exp(ahead[i][:, None] + score + behind[j][:, None] - ahead[self.n])

    def first(self, j: int) -> int:
        """Number of the first segment that ends with token j."""
        short = min(j - 1, MAX_TOKENS)
        return short * (short + 1) // 2 + max(0, j - 1 - MAX_TOKENS) * MAX_TOKENS


def token_spans(text: str, start: int = 0) -> list[tuple[int, int]]:
    return [(start + m.start(), start + m.end()) for m in _TOKEN.finditer(text)]


#: Generated lines, passes over them, step size and penalty of the weights.
LINES, PASSES, STEP, PENALTY = 700, 4, 0.5, 1e-3


@functools.cache
def train(seed: int = 7) -> Field:
    """The likelihood of generated lines, climbed line by line with the steps of AdaGrad."""
    rng, number = random.Random(seed), {}
    data = [_Lattice(*_made_sentence(rng), number, True) for _ in range(LINES)]
    w, bias = np.zeros((len(number), len(KINDS))), np.full(len(KINDS), -2.0)
    seen, seen_bias = np.full(w.shape, 1e-6), np.full(bias.shape, 1e-6)
    for _ in range(PASSES):
        for line in data:
            slope = -line.expected(w, bias)
            for k, kind in line.gold:
                slope[k, kind] += 1.0
            total = slope.sum(axis=0)
            seen_bias += total**2
            bias += STEP * total / np.sqrt(seen_bias)
            used, where = np.unique(line.features, return_inverse=True)
            change = np.zeros((len(used), len(KINDS)))
            np.add.at(change, where, slope[line.rows])
            change -= PENALTY * w[used]
            seen[used] += change**2
            w[used] += STEP * change / np.sqrt(seen[used])
    return Field({f: w[i].tolist() for f, i in number.items() if np.abs(w[i]).max() > 0.01}, bias.tolist())


def _tokens_before(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The last MAX_TOKENS tokens of text[start:end]; what is read grows until they are whole."""
    reach = 16 * MAX_TOKENS
    while True:
        lo = max(start, end - reach)
        tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, lo, end)]
        if lo == start:
            return tokens[-MAX_TOKENS:]
        if len(tokens) > MAX_TOKENS:  # the first one may be cut
            return tokens[-MAX_TOKENS:]
        reach *= 2


_LEADS = re.compile("|".join(sorted(_TITLES | _CUES, key=lambda w: (-len(w), w))))


def _triggers(text: str):
    """(start, end) of every trigger, in order: what _TRIGGER matches, found by two fast patterns."""
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case has another length
        yield from (m.span() for m in _TRIGGER.finditer(text))
        return

    def leads():
        at = 0
        while m := _LEADS.search(low, at):
            a, b = m.span()
            whole = next((len(w) for w in _BY_START[m.group()[:2]] if low.startswith(w, a) and not _is_word(low, a + len(w))), 0)
            if whole and not (a and _is_word(low, a - 1)):
                yield a, a + whole
                at = a + whole
            else:
                at = a + 1

    yield from heapq.merge((m.span() for m in _HOT.finditer(text)), leads())


def _is_word(text: str, at: int) -> bool:
    return at < len(text) and (text[at].isalnum() or text[at] == "_")


#: Titles and cues by their first two letters, longer ones first.
_BY_START: dict[str, list[str]] = {}
for _w in sorted(_TITLES | _CUES, key=lambda w: (-len(w), w)):
    _BY_START.setdefault(_w[:2], []).append(_w)


def windows(text: str):
    """Token runs within lines: MAX_TOKENS on each side of every trigger; runs that meet are one."""
    found = _triggers(text)
    m = next(found, None)
    while m:
        start, end = text.rfind("\n", 0, m[0]) + 1, text.find("\n", m[0])
        end = len(text) if end < 0 else end
        tokens = _tokens_before(text, start, m[0])
        last = len(tokens)  # the tokens up to the last trigger's end
        for t in _TOKEN.finditer(text, m[0], end):
            while m and m[1] <= t.start():
                m = next(found, None)
            tokens.append((t.start(), t.end()))
            if m and m[0] < t.end():
                last = len(tokens)
            elif len(tokens) >= last + 2 * MAX_TOKENS:
                break
        tokens = tokens[: last + MAX_TOKENS]
        yield tokens
        while m and m[0] < tokens[-1][1]:
            m = next(found, None)


def field_spans(field: Field, text: str) -> list[tuple[str, int, int]]:
    """Spans that the field finds in the windows around triggers."""
    return [x for tokens in windows(text) for x in segment(field, text, tokens)]


def find(field: Field, text: str) -> tuple[list, list]:
    """(base spans, all spans)."""
    base = base_spans(text)
    taken = sorted((s, e) for _, s, e in base)
    more = [x for x in field_spans(field, text) if not any(s < x[2] and x[1] < e for s, e in taken)]
    return base, base + more


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, base counts, checksum of the base spans, all spans as text and their number."""
    fitted = train()
    state = fitted.weights, fitted.bias

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")
    def run(texts: pd.Series) -> pd.DataFrame:
        field, rows = Field(*state), []
        for t in texts:
            base, spans = find(field, t or "")
            n = [sum(k == kind for k, _, _ in base) for kind in BASE]
            rows.append((*n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), len(spans)))
        return pd.DataFrame(rows, columns=[*(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_spans"])

    return docs.select("doc_id", run("text").alias("found")).select("doc_id", "found.*")


def op9_pii(spark, sf_dir):
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pii_base(spark, sf_dir):
    """The columns of op9_pii that patterns alone decide."""
    return op9_pii(spark, sf_dir).select("doc_id", *(f"n_{k}" for k in BASE), "base_sha256")


def _sql() -> str:
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn_sum = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN ({digits})[-i]::INT WHEN ({digits})[-i]::INT > 4 THEN ({digits})[-i]::INT * 2 - 9 ELSE ({digits})[-i]::INT * 2 END))"
    kinds = {
        "email": ("[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+", "TRUE"),
        "ip": ("[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR (length(ltrim(x, '0')) = 3 AND ltrim(x, '0') > '255'))) = 0"),
        "card": ("[0-9]([\\x20-]?[0-9])+", f"length({digits}) BETWEEN 12 AND 19 AND {luhn_sum} % 10 = 0"),
        "phone": ("\\+[0-9][\\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 9 AND 15"),
    }
    found = " UNION ALL ".join(
        f"""SELECT r, {n} AS ord, '{k}' AS kind, p AS start_, p + length(m) AS end_ FROM (SELECT r, unnest(m) AS m,
 unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(rest[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT)) AS p
 FROM (SELECT r, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS rest FROM d WHERE regexp_matches(text, '{pattern}'))) WHERE {test}"""
        for n, (k, (pattern, test)) in enumerate(kinds.items())
    )
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), s AS ({found}),
g AS (SELECT r, {counts}, string_agg(kind || ':' || start_ || ':' || end_, ',' ORDER BY start_, ord) AS base FROM s GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256 FROM d LEFT JOIN g USING (r)"""


PII_BASE_SQL = _sql()
