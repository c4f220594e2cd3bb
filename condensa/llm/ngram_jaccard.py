"""Operator 10: n-gram Jaccard join by T-occurrence search.

A document's set holds the 64-bit hashes of its distinct word shingles; documents
with equal sets collapse to one key first.  Two sets reach Jaccard t only if they
meet in the first n - ceil(t n) + 1 shingles of a global order (light shingles
first, heavy ones last), so only those prefixes are posted.  Token groups with the
same members are searched once; members without another of a near size leave first,
then a parity bitmap gives a lower bound of the symmetric difference, and what
survives is joined to cells.  Each cell's
full sets are then searched exactly: the short inverted lists are merged, the long
ones probed by binary search (DivideSkip), and documents reaching the overlap link.

No task holds an unbounded group.  A group over BLOCK members is first split by set
size, as linked sets are of near sizes.  What stays over a block is linked block by block;
one member stands for each component found, these are linked, and only members outside
the group's largest component then meet all others.  So copies of one text cost a few
passes however many they are, and no link between components is lost.  Links meet again
in the distributed components.

Defined results: null or empty text has no shingles, n_shingles 0, and links with
nothing; fewer words than the width make one shingle; repeated rows give repeated
result rows; null doc_id rows take part and are never the smallest id; ids stay in
the JVM, so none is rounded; texts of any length are read whole; an empty table gives
no rows.  Other columns of the input are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from condensa.llm._kit import components, durable, forget, held_join, local_roots, may_be_in, row_key, sized_join, sorted_groups, windows_hash, without, word_hashes

#: Members of a token group or cell that one task compares at once, and shingles that they hold.
BLOCK, BLOCK_SHINGLES = 8192, 8_000_000
#: A shingle is heavy from this share of the documents on (and from HEAVY_LEAST on).
HEAVY_SHARE, HEAVY_LEAST = 1e-3, 16
#: Shingles that are counted together before a chunk's repeated ones are passed on.
CHUNK = 2_000_000
#: Heavy shingles that the driver holds at most, the heaviest ones.
HEAVY_MOST = 1_000_000


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    return np.unique(windows_hash(h, list(range(min(width, len(h)))), seed=min(width, len(h))))


def _text_hash() -> Column:
    """Two hashes, by which one text of each set is found again."""
    return F.struct(F.xxhash64("text").alias("x"), F.xxhash64("text", F.lit(1)).alias("y"))


def set_key(s: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(s.tobytes())


def prefix_len(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def parity_bits(s: np.ndarray, percent: int) -> bytes:
    """Bitmap of the parity of hashed members; XOR counts at most the symmetric difference.

    Its width follows the greatest difference of linked sets: unlinked ones differ in
    about half of the places, which has to lie clearly above it.
    """
    most = 2 * (100 - percent) * len(s) / (100 + percent)
    width = 128
    while width < 2.8 * most and width < 16384:
        width *= 2
    odd = np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _heavy_chunks(width: int):
    def run(batches):
        held, size, docs = [], 0, 0

        def flush():
            u, c = np.unique(np.concatenate(held), return_counts=True)
            keep = c >= max(2, int(HEAVY_SHARE * docs))
            return pd.DataFrame({"token": u[keep].view(np.int64), "n": c[keep]})

        for pdf in batches:
            for t in pdf["text"]:
                s = shingles(t, width)
                held.append(s)
                size, docs = size + len(s), docs + 1
                if size >= CHUNK:
                    yield flush()
                    held, size, docs = [], 0, 0
        if held:
            yield flush()

    return run


def heavy_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in at least HEAVY_SHARE of the documents, with counts.

    At most 1 / HEAVY_SHARE times the mean set size of them exist, whatever the
    number of documents; of these the driver holds HEAVY_MOST.  They only set the
    order of the prefixes: a miss costs time, never a link.
    """
    counts = docs.select("text").mapInPandas(_heavy_chunks(width), "token long, n long")
    least = max(HEAVY_LEAST, int(HEAVY_SHARE * docs.count()))
    rows = counts.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "token").limit(HEAVY_MOST).toPandas()
    token = rows["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], rows["n"].to_numpy(np.int64)[order]


def _describe(width: int, percent: int, heavy):
    """Of a text: set size, key, prefix and bitmap of its set; nulls without shingles."""

    @F.pandas_udf("n int, k string, prefix array<long>, bits binary")
    def run(texts: pd.Series) -> pd.DataFrame:
        tokens, counts = heavy.value
        out = []
        for t in texts:
            s = shingles(t, width)
            if not len(s):
                out.append((0, None, None, None))
                continue
            at = np.searchsorted(tokens, s)
            at[at == len(tokens)] = 0
            is_heavy = tokens[at] == s if len(tokens) else np.zeros(len(s), bool)
            need = prefix_len(len(s), percent)
            light = s[~is_heavy][:need]
            if len(light) < need:
                h = s[is_heavy]
                h = h[np.lexsort((h, counts[at[is_heavy]]))]
                light = np.concatenate([light, h[: need - len(light)]])
            out.append((len(s), set_key(s), light.view(np.int64), parity_bits(s, percent)))
        return pd.DataFrame(out, columns=["n", "k", "prefix", "bits"])

    return run


class _Bitmaps:
    """Vectorised test of pairs by size and parity bitmap."""

    def __init__(self, n: np.ndarray, bits: list[bytes], percent: int):
        self.n, self.percent = n.astype(np.int64), percent
        width = np.array([len(b) for b in bits])
        self.at, self.tables, self.width = np.zeros(len(bits), np.int64), {}, width
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            self.at[rows] = np.arange(len(rows))
            self.tables[w] = np.frombuffer(b"".join(bits[i] for i in rows), np.uint64).reshape(len(rows), -1)

    def _table(self, w, to):
        t = self.tables[w]
        while w > to:
            t, w = t[:, : t.shape[1] // 2] ^ t[:, t.shape[1] // 2 :], w // 2
        return t

    def close(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = self.n[a] + self.n[b]
        budget = (100 - self.percent) * total
        ok = (100 + self.percent) * np.abs(self.n[a] - self.n[b]) <= budget
        left = np.flatnonzero(ok)
        wa, wb = self.width[a[left]], self.width[b[left]]
        code = wa * 65536 + wb
        for c in np.unique(code):
            part = left[code == c]
            w1, w2 = int(c) // 65536, int(c) % 65536
            to = min(w1, w2)
            x = self._table(w1, to)[self.at[a[part]]] ^ self._table(w2, to)[self.at[b[part]]]
            diff = np.bitwise_count(x).sum(axis=1, dtype=np.int64)
            ok[part] = (100 + self.percent) * diff <= budget[part]
        return ok


def _pairs_of_group(rows: np.ndarray, maps: _Bitmaps) -> tuple[list, list]:
    """Spanning edges of the surviving pairs of a large group, by breadth-first passes."""
    a, b, left = [], [], rows
    queue: list[int] = []
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
        q = queue.pop()
        hit = maps.close(np.full(len(left), q), left)
        got = left[hit]
        a += [q] * len(got)
        b += got.tolist()
        queue += got.tolist()
        left = left[~hit]
    return a, b


def _group_edges(percent: int):
    small = 48

    def run(batches):
        for pdf in sorted_groups(batches, "g"):
            codes, keys = pd.factorize(pdf["r"].to_numpy())
            first = np.unique(codes, return_index=True)[1]
            maps = _Bitmaps(pdf["n"].to_numpy()[first], [pdf["bits"].iloc[i] for i in first], percent)
            g = pdf["g"].to_numpy()
            start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            size = np.diff(np.r_[start, len(g)])
            sizes = np.repeat(size, size)
            pa, pb = [], []
            for shift in range(1, int(min(small, size.max()))):
                i = np.flatnonzero((g[shift:] == g[:-shift]) & (sizes[shift:] <= small))
                if len(i):
                    pair = np.unique(np.minimum(codes[i], codes[i + shift]) * len(keys) + np.maximum(codes[i], codes[i + shift]))
                    x, y = pair // len(keys), pair % len(keys)
                    hit = maps.close(x, y)
                    pa.append(x[hit])
                    pb.append(y[hit])
            for s, m in zip(start[size > small], size[size > small], strict=True):
                x, y = _pairs_of_group(np.unique(codes[s : s + m]), maps)
                pa.append(np.array(x, np.int64))
                pb.append(np.array(y, np.int64))
            if not pa:
                continue
            root = local_roots(len(keys), np.concatenate(pa), np.concatenate(pb))
            away = np.flatnonzero(root != np.arange(len(keys)))
            if len(away):
                yield pd.DataFrame({"a": keys[away], "b": keys[root[away]]})

    return run


def _far_edges(percent: int):
    """Close pairs of a group's flagged rows with rows of another root."""

    def run(batches):
        for pdf in sorted_groups(batches, "g"):
            for _, part in pdf.groupby("g", sort=False):
                far = np.flatnonzero(part["far"].to_numpy(bool))
                if not len(far):
                    continue
                maps = _Bitmaps(part["n"].to_numpy(), part["bits"].tolist(), percent)
                node, root = part["r"].to_numpy(), part["root"].to_numpy()
                a, b = [], []
                for q in far:
                    others = np.flatnonzero(root != root[q])
                    got = others[maps.close(np.full(len(others), q), others)]
                    if len(got):  # one link to each root is enough
                        got = got[np.unique(root[got], return_index=True)[1]]
                        a.append(np.full(len(got), node[q]))
                        b.append(node[got])
                if a:
                    yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


class DivideSkip:
    """Inverted lists over a block of sets, searched for members reaching an overlap."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        self.n = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        _, ids = np.unique(flat, return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), self.n)
        order = np.argsort(ids, kind="stable")
        self.owner = owner[order]
        self.starts = np.searchsorted(ids[order], np.arange(ids.max() + 2))
        self.members = np.split(ids, np.cumsum(self.n)[:-1])

    def search(self, q: int, alive: np.ndarray) -> np.ndarray:
        lists = self.members[q]
        length = self.starts[lists + 1] - self.starts[lists]
        need = -(-self.percent * int(self.n[q]) // 100)  # least overlap with any partner
        order = lists[np.argsort(length, kind="stable")]
        n_long = need - 1 if len(order) - need + 1 > 0 else 0
        short, long = order[: len(order) - n_long], order[len(order) - n_long :]
        cand, hits = np.unique(np.concatenate([self.owner[self.starts[i] : self.starts[i + 1]] for i in short]), return_counts=True)
        keep = alive[cand] & (hits >= need - n_long) & (100 * np.minimum(self.n[cand], self.n[q]) >= self.percent * np.maximum(self.n[cand], self.n[q]))
        cand, hits = cand[keep], hits[keep]
        left = n_long
        for i in long:
            if not len(cand):
                break
            run = self.owner[self.starts[i] : self.starts[i + 1]]
            at = np.searchsorted(run, cand)
            at[at == len(run)] = 0
            hits = hits + (run[at] == cand)
            left -= 1
            if left % 16 == 0:  # those that the remaining lists cannot lift are dropped
                ok = hits + left >= need
                cand, hits = cand[ok], hits[ok]
        return cand[100 * hits >= self.percent * (self.n[cand] + self.n[q] - hits)]


def link_components(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Smallest linked index of each set of a block, links being exact."""
    root = np.arange(len(sets))
    todo = np.arange(len(sets))
    queue: list[tuple[int, int]] = []
    index, base = DivideSkip(sets, percent), todo
    alive = np.ones(len(sets), bool)  # by position in base
    n_alive = len(base)
    while n_alive or queue:
        if not queue:
            p = int(np.argmax(alive))
            alive[p] = False
            n_alive -= 1
            queue.append((p, int(base[p])))
        p, r = queue.pop()
        if not n_alive:
            continue
        got = index.search(p, alive)
        alive[got] = False
        n_alive -= len(got)
        root[base[got]] = r
        queue += [(int(x), r) for x in got]
        if len(base) > 256 and n_alive < len(base) // 2 and n_alive:
            keep = np.unique(np.concatenate([np.flatnonzero(alive), np.array([x for x, _ in queue], np.int64)]))
            if len(keep) < 3 * len(base) // 4:
                where = {int(x): i for i, x in enumerate(keep)}
                queue = [(where[x], y) for x, y in queue]
                alive, base = alive[keep], base[keep]
                index = DivideSkip([sets[i] for i in base], percent)
    return root


def _cell_edges(width: int, percent: int):
    def run(batches):
        for pdf in sorted_groups(batches, "g"):
            for _, part in pdf.groupby("g", sort=False):
                part = part.drop_duplicates("k")
                sets, keys = [], []
                for k, t in zip(part["k"], part["text"], strict=True):
                    s = shingles(t, width)
                    if set_key(s) == k:
                        sets.append(s)
                        keys.append(k)
                if len(sets) < 2:
                    continue
                root = link_components(sets, percent)
                away = np.flatnonzero(root != np.arange(len(sets)))
                if len(away):
                    names = np.array(keys, object)
                    yield pd.DataFrame({"a": names[away], "b": names[root[away]]})

    return run


def _far_cell_edges(width: int, percent: int):
    """Links of a cell's flagged sets with sets of another root."""

    def run(batches):
        for pdf in sorted_groups(batches, "g"):
            for _, part in pdf.groupby("g", sort=False):
                flagged = part.groupby("k")["far"].max()
                part = part.drop_duplicates("k")
                if not flagged.any() or len(part) < 2:
                    continue
                far, root, keys = flagged[part["k"]].to_numpy(bool), part["root"].to_numpy(), part["k"].to_numpy()
                index = DivideSkip([shingles(t, width) for t in part["text"]], percent)
                found = [(keys[q], keys[x]) for q in np.flatnonzero(far) for x in index.search(q, root != root[q])]
                if found:
                    yield pd.DataFrame(found, columns=["a", "b"])

    return run


def _block(key: str, parts: Column) -> Column:
    return F.pmod(F.xxhash64(key), parts).cast("int")


def _own_blocks(rows: DataFrame, key: str) -> DataFrame:
    """Add g: a row's block of its group (t, of parts blocks)."""
    return rows.withColumn("g", F.xxhash64("t", _block(key, F.col("parts"))))


def _block_pairs(rows: DataFrame, key: str) -> DataFrame:
    """Add g: the group itself, or for more parts each pair of blocks that a row is in."""
    n, mine = F.col("parts").cast("int"), _block(key, F.col("parts"))
    others = F.filter(F.sequence(F.lit(0), n - 1), lambda x: x != mine)
    pairs = F.when(n <= 1, F.array(F.lit("0"))).otherwise(F.transform(others, lambda x: F.concat_ws("-", F.least(x, mine), F.greatest(x, mine))))
    return rows.withColumn("pair", F.explode(pairs)).withColumn("g", F.xxhash64("t", "pair")).drop("pair")


def _meet_far(rows: DataFrame, key: str) -> DataFrame:
    """Rows by pairs of a block of the group and a block of its far rows; parts and far_parts count them."""
    mine, far = _block(key, F.col("parts")), _block(key, F.col("far_parts"))
    every = lambda n: F.sequence(F.lit(0), n.cast("int") - 1)
    near = rows.withColumn("i", mine).withColumn("j", F.explode(every(F.col("far_parts")))).withColumn("far", F.lit(False))
    away = rows.where("far").withColumn("j", far).withColumn("i", F.explode(every(F.col("parts"))))
    return near.unionByName(away).withColumn("g", F.xxhash64("t", "i", "j")).drop("i", "j")


def group_links(rows: DataFrame, key: str, ship, within, across, kind: str) -> DataFrame:
    """Edges (a, b) that join what is linked in each group t of rows (t, parts, key, n).

    ship adds the payload to rows of (g, key, ...); within links the rows of a g, across
    the far rows of a g with those of another root.  kind is the key's type.
    """
    def links(df: DataFrame, fn) -> DataFrame:
        wide = ship(df)
        wide = wide.select(*(c for c in wide.columns if c not in ("t", "parts", "far_parts")))
        return durable(wide.repartition("g").sortWithinPartitions("g").mapInPandas(fn, f"a {kind}, b {kind}"), "jaccard-links")

    edges = links(_own_blocks(rows, key), within)
    giant = rows.where("parts > 1")
    if not giant.limit(1).count():
        return edges

    def rooted(found: DataFrame) -> DataFrame:
        roots = components(found).withColumnRenamed("node", key)
        return durable(giant.join(roots, key, "left").withColumn("root", F.coalesce("root", key)), "jaccard-giant")

    # one member for each component of a group
    ones = rooted(edges).groupBy("t", "root").agg(F.min(F.struct(key, "n")).alias("x")).select("t", f"x.{key}", "x.n")
    counts = ones.groupBy("t").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    edges = edges.unionByName(links(_block_pairs(ones.join(counts, "t"), key), within))
    known = rooted(edges)
    sizes = known.groupBy("t", "root").agg(F.count("*").alias("m"))
    largest = sizes.groupBy("t").agg(F.max(F.struct("m", "root")).alias("x"), F.sum("m").alias("all")).select("t", F.col("x.root").alias("main"), F.ceil((F.col("all") - F.col("x.m")) / BLOCK).alias("far_parts"))
    todo = known.join(largest.where("far_parts > 0"), "t").withColumn("far", F.col("root") != F.col("main")).drop("main")
    if not todo.limit(1).count():
        return edges
    return edges.unionByName(links(_meet_far(todo, key), across))


def _by_size(members: DataFrame, percent: int) -> DataFrame:
    """Members (token, r, n, v) as groups (t, parts, r, n): a token's, or if that is over BLOCK, those of its sizes next to each other."""
    small = members.where(F.col("v") <= BLOCK).select(F.xxhash64("token").alias("t"), F.lit(1).cast("long").alias("parts"), "r", "n")
    large = members.where(F.col("v") > BLOCK)
    # sizes of linked sets fall into the same band or into two next to each other
    band = F.floor(F.log("n") / math.log(100 / percent) + 1e-9).cast("int")
    banded = large.withColumn("band", F.explode(F.array(band, band + 1))).select(F.xxhash64("token", "band").alias("t"), "r", "n")
    counts = banded.groupBy("t").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("parts"))
    return small.unionByName(banded.join(counts, "t").select("t", "parts", "r", "n"))


def _with_near_size(rows: DataFrame, percent: int) -> DataFrame:
    """The members of a group g that have another of a size they could be linked with.

    Sizes of linked sets differ by the similarity at most, so the next smaller and
    the next larger member tell.
    """
    by_size = Window.partitionBy("g").orderBy("n")
    seen = rows.withColumn("below", F.lag("n").over(by_size)).withColumn("above", F.lead("n").over(by_size))
    return seen.where((100 * F.col("below") >= percent * F.col("n")) | (100 * F.col("n") >= percent * F.col("above"))).select(*rows.columns)


def ngram_jaccard(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, k (the set's key, null without shingles)."""
    docs = docs.select("doc_id", "text")
    sc = docs.sparkSession.sparkContext
    heavy = sc.broadcast(heavy_shingles(docs, width))
    described = docs.select("doc_id", _text_hash().alias("th"), _describe(width, percent, heavy)("text").alias("x"))
    rows = durable(described.select("doc_id", "th", "x.*"), "jaccard-rows")
    full = rows.where("n > 0")
    reps = durable(full.groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.min("th").alias("th"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits")), "jaccard-reps")
    # up to the exact search a set goes by 64 bits of its key: a clash joins two cells, no more
    reps_r = reps.withColumn("r", F.xxhash64("k"))
    post = reps_r.select(F.explode("prefix").alias("token"), "r", "n")
    tokens = post.groupBy("token").agg(F.count("*").cast("int").alias("v"), F.bit_xor("r").alias("x"), F.bit_xor(F.xxhash64("r")).alias("y")).where("v > 1")
    kept = durable(tokens.groupBy("v", "x", "y").agg(F.min("token").alias("token")).select("token", "v"), "jaccard-tokens")
    members = sized_join(may_be_in(post, "token", kept), kept, "token", "inner", 24)
    bits = reps_r.select("r", "bits")
    close = group_links(_by_size(members, percent), "r", lambda df: _with_near_size(df, percent).join(bits, "r"), _group_edges(percent), _far_edges(percent), "long")
    cells = components(close).withColumnRenamed("node", "r").withColumnRenamed("root", "cell")
    cells = cells.unionByName(cells.select(F.col("cell").alias("r"), "cell").distinct())
    named = cells.join(reps_r.select("r", "k", "th", "n"), "r").drop("r")
    sizes = named.groupBy("cell").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("long").alias("parts"))
    want = durable(named.join(sizes, "cell"), "jaccard-cells")
    # one text of each set: copies are dropped where they lie, before any is shipped
    held = held_join(docs.where("text is not null").select(_text_hash().alias("th"), "text"), want.select("th", F.col("k").alias("set")), "th", 80)
    texts = durable(held.groupBy("set").agg(F.first("text").alias("text")).withColumnRenamed("set", "k"), "jaccard-texts")
    grouped = want.select(F.xxhash64("cell").alias("t"), "parts", "k", "n")
    exact = group_links(grouped, "k", lambda df: df.join(texts, "k"), _cell_edges(width, percent), _far_cell_edges(width, percent), "string")
    links = components(exact)
    forget(kept, want, texts)  # what follows reads the rows, their representatives and the links
    ids = reps.select("k", "doc_id").join(links.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    low = ids.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = ids.join(low, "root").select("k", "component_id")
    out = rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "k").join(named, "k", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "k")


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows without those that a linked row of a smaller id (null last), or of the same id, stands for.

    Of equal ids and texts one row stays; columns of any name pass.
    """
    key = row_key(docs["doc_id"], docs["text"])
    rows = docs.select(key.alias("row"), "doc_id")
    found = ngram_jaccard(docs.select(key.alias("doc_id"), "text"), width, percent)
    found = durable(found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("group")), "jaccard-found")
    groups = found.distinct().join(rows.distinct(), "row")
    stay = groups.groupBy("group").agg(F.min(F.struct(F.isnull("doc_id").alias("last"), "doc_id", "row")).alias("x")).select("x.row")
    gone = durable(groups.select("row").subtract(stay), "jaccard-gone")
    kept = without(docs, key, gone)
    again = found.groupBy("row").count().where("count > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if again else kept


def op10_ngram_jaccard(spark, sf_dir):
    return ngram_jaccard(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90).drop("k")


#: All pairs that share a shingle, and the smallest id of each component.
OP10_SQL = """
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT r, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END)) AS x FROM d),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS MATERIALIZED (SELECT a.r AS a, b.r AS b, count(*) AS common FROM s a JOIN s b ON a.x = b.x AND a.r < b.r GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
l AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c AS (SELECT r, r AS reached FROM n UNION SELECT c.r, l.b FROM c JOIN l ON l.a = c.reached),
m AS (SELECT c.r, min(d.doc_id) AS component_id FROM c JOIN d ON d.r = c.reached GROUP BY c.r)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, CASE WHEN n.n IS NULL THEN d.doc_id ELSE m.component_id END AS component_id FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)
"""
