"""Places of pattern matches in texts, by DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A private-use character marks the cuts; the text's own ones are swapped for another of no word or pattern class.
CUT, SWAP = "\ue000", "\ue001"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once a row, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def match_pieces(text: Column, pattern: str, piece_ok: Callable[[Column], Column]) -> Column:
    """Array of struct(n, hit): the text's pieces in and between leftmost non-overlapping matches.

    Matches are wrapped in cut marks and the text is split at them, so every other piece
    is a match.  n counts code points; hit tells a match that piece_ok lets count.
    """
    marked = F.regexp_replace(F.translate(text, CUT, SWAP), pattern, f"{CUT}$0{CUT}")
    return F.transform(F.split(marked, CUT), lambda piece, i: F.struct(F.length(piece).cast("long").alias("n"), ((i % 2 == 1) & piece_ok(piece)).alias("hit")))


def spans_of(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """keys, spans (array of struct(start, ord, end, kind)) of rows keys, ord, kind, pieces; rows of equal keys and ord count once.

    Running sums over the pieces give the places: the work grows with the pieces, however
    many a text has.  Texts without a counted match have no row.
    """
    once = pieces.dropDuplicates([*keys, "ord"])
    each = once.select(*keys, "ord", "kind", F.posexplode("pieces").alias("at", "piece"))
    end = F.sum("piece.n").over(Window.partitionBy(*keys, "ord").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    found = each.withColumn("end", end).where("piece.hit")
    span = F.struct((F.col("end") - F.col("piece.n")).alias("start"), "ord", "end", "kind")
    return found.groupBy(*keys).agg(F.collect_list(span).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end by start, then listed order, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
