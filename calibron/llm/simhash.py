"""SimHash near-duplicates: fingerprints of word shingles, joined by walking a binary trie with itself.

Defined results: a null or wordless text has fingerprint zero and is linked like any other; equal
fingerprints are one class; a null doc_id keeps its row, takes the class of its fingerprint and never
names a component; repeated rows give repeated result rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibron.llm.common import LOWER_AZ, columns_of, components, map_texts, written

SEED = 42
CHUNK = 1 << 16


def fingerprint(text: str | None, width: int = 4) -> int:
    """64-bit SimHash of the lower-cased (A-Z) word shingles of a text, repeats counted."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_AZ).split()
    n = len(words)
    if n == 0:
        return 0
    if n <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, n)
    stops = np.cumsum(lens + 1) - 1
    starts = (stops - lens)[: n - width + 1].tolist()
    stops = stops[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + CHUNK], stops[at : at + CHUNK], strict=True)], np.uint64)
        set_bits += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * set_bits > len(starts)).view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp): one row for each document, in the scan's own tasks."""

    def run(texts: list[str | None]) -> list:
        return [np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)]

    return map_texts(docs, run, "fp long")


#: (depth, most differing bits among the upper ``depth``) from the top down to depth 64.
Budgets = tuple[tuple[int, int], ...]
#: Pairs of ranges of an array: from al to ah, from bl to bh.
Frontier = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def trie_pairs(keys: np.ndarray, start: Frontier, budgets: Budgets, bit: int = 63, most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of ``keys`` (uint64) that differ in at most ``errors`` of the upper ``depth`` bits for
    each (depth, errors) of ``budgets``, of all pairs of ranges in ``start``; ``bit`` is the first that isn't equal.

    A node of a trie is a sorted range of the array. Pairs of nodes go down together, one bit at a time:
    children of equal bits keep the count of differing bits, children of unequal bits add one, and a pair
    over the budget goes no further. Small pairs of nodes are compared leaf by leaf. The frontier is
    handled in pieces of at most ``most`` pairs, so memory stays bounded.
    """
    zeros: dict[int, np.ndarray] = {}
    live = (start[1] > start[0]) & (start[3] > start[2])
    stack = [(bit, *(x[live].astype(np.int64) for x in start), np.zeros(int(live.sum()), np.int64))]
    while stack:
        bit, al, ah, bl, bh, d = stack.pop()
        if len(al) > most:
            for at in range(0, len(al), most):
                stack.append((bit, *(t[at : at + most] for t in (al, ah, bl, bh, d))))
            continue
        small = ((ah - al) * (bh - bl) <= 32) | (bit < 0)
        if small.any():
            x, y, w, v = al[small], ah[small] - al[small], bl[small], bh[small] - bl[small]
            count = y * v
            piece = np.cumsum(count) // (1 << 18)  # leaves of equal keys can be large
            for of in np.unique(piece):
                at = piece == of
                n = count[at]
                own = np.repeat(np.arange(len(n)), n)
                k = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
                i, j = x[at][own] + k // v[at][own], w[at][own] + k % v[at][own]
                diff = keys[i] ^ keys[j]
                near = i < j
                for depth, errors in budgets:
                    near &= np.bitwise_count(diff >> np.uint64(64 - depth)) <= errors
                if near.any():
                    yield i[near], j[near]
            al, ah, bl, bh, d = (t[~small] for t in (al, ah, bl, bh, d))
        if not len(al):
            continue
        if bit not in zeros:
            zeros[bit] = np.concatenate(([0], np.cumsum((keys >> np.uint64(bit)) & np.uint64(1) == 0)))
        z = zeros[bit]
        am = al + z[ah] - z[al]
        bm = bl + z[bh] - z[bl]
        twin = (al == bl) & (ah == bh)
        parts = [(al, am, bl, bm, d), (am, ah, bm, bh, d), (al, am, bm, bh, d + 1)]
        crossed = tuple(t[~twin] for t in (am, ah, bl, bm, d + 1))  # of a node with itself it would come twice
        al, ah, bl, bh, d = (np.concatenate(t) for t in zip(*parts, crossed, strict=True))
        live = (ah > al) & (bh > bl) & (d <= next(errors for depth, errors in budgets if 64 - bit <= depth))
        stack.append((bit - 1, *(t[live] for t in (al, ah, bl, bh, d))))


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the pairs, which are used up piece by piece."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            ri, rj = root[i], root[j]
            apart = ri != rj
            if not apart.any():
                break
            np.minimum.at(root, np.maximum(ri, rj)[apart], np.minimum(ri, rj)[apart])
            while (root[root] != root).any():
                root = root[root]
            i, j = i[apart], j[apart]
    return root


#: Rows of a top node that one unit takes; those of a larger node are dealt out by blocks.
NODE_ROWS = 16_384
#: Rows that a task walks together, whole units of them.
WALK_ROWS = 1 << 15


def top_depth(rows: int, leaf_rows: float = 2048) -> int:
    """Levels of a trie of so many rows above nodes of about ``leaf_rows``."""
    return int(np.ceil(np.log2(max(1, rows) / leaf_rows)))


#: The columns that tell the units of :func:`met` apart.
UNIT = ("turn", "low", "high", "first", "second")


def met(views: DataFrame, payload: list[str], node_rows: int = NODE_ROWS, weight: F.Column | None = None) -> DataFrame:
    """The rows of ``views(turn, node, partner, rep, payload ...)`` dealt to the units (``UNIT``) in which they meet, with their side.

    A row is there once for each node that its own meets (partner), its own included. A node of more than
    ``node_rows`` rows (or of that sum of ``weight``) is cut into blocks by the hash of the id, and each of its blocks meets each of the
    other node's blocks in a unit of its own: no task grows with a hot node, and no pair is lost.
    """
    blocks = F.ceil(F.col("rows") / node_rows).cast("int")
    own_rows = views.where("node = partner").groupBy("turn", "node").agg(F.sum(F.lit(1) if weight is None else weight).alias("rows"))
    large = written(own_rows.where(F.col("rows") > node_rows).select("turn", "node", blocks.alias("blocks")), "simhash_large")
    own, other = (large.select(F.col("turn").alias(f"{x}_turn"), F.col("node").alias(f"{x}_node"), F.col("blocks").alias(f"{x}_blocks")) for x in ("own", "other"))
    rows = views.join(own, (views["turn"] == F.col("own_turn")) & (views["node"] == F.col("own_node")), "left")
    rows = rows.select("turn", "node", "partner", "rep", *payload, F.pmod(F.xxhash64("rep"), F.coalesce("own_blocks", F.lit(1))).cast("int").alias("own"))
    rows = rows.join(other, (rows["turn"] == F.col("other_turn")) & (rows["partner"] == F.col("other_node")), "left")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("other_blocks", F.lit(1)) - 1)))
    twin, upper = F.col("node") == F.col("partner"), F.col("node") > F.col("partner")
    first = F.when(twin, F.least("own", "other")).when(upper, F.col("other")).otherwise(F.col("own"))
    second = F.when(twin, F.greatest("own", "other")).when(upper, F.col("own")).otherwise(F.col("other"))
    # In a twin unit of two blocks the rows of the second block have own > other.
    return rows.select("turn", F.least("node", "partner").alias("low"), F.greatest("node", "partner").alias("high"), first.alias("first"), second.alias("second"), F.when(twin, F.col("own") > F.col("other")).otherwise(upper).alias("side"), "rep", *payload)


class Units:
    """Rows of whole units, sorted by unit, side and key."""

    def __init__(self, pdf: pd.DataFrame, keys_of):
        unit = np.cumsum(changed(pdf))
        side, keys = pdf["side"].to_numpy(bool), keys_of(pdf)
        order = np.lexsort((keys, side, unit))
        self.pdf, self.keys, self.unit = pdf.iloc[order], keys[order], unit[order]
        begin = np.flatnonzero(np.diff(self.unit, prepend=-1))
        end = np.append(begin[1:], len(order))
        upto = np.concatenate(([0], np.cumsum(side[order])))
        middle = end - (upto[end] - upto[begin])
        two = (self.pdf["low"].to_numpy() != self.pdf["high"].to_numpy())[begin] | (self.pdf["first"].to_numpy() != self.pdf["second"].to_numpy())[begin]
        #: A unit of one block meets itself, one of two blocks has its sides meet.
        self.start = (begin, np.where(two, middle, end), np.where(two, middle, begin), end)


def changed(pdf: pd.DataFrame) -> np.ndarray:
    """Where a sorted frame's unit differs from that of the row before."""
    out = np.zeros(len(pdf), bool)
    for c in UNIT:
        x = pdf[c].to_numpy()
        out[1:] |= x[1:] != x[:-1]
    return out


def whole_units(parts: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """The rows of a partition that is sorted by unit, in pieces of about ``most`` that cut no unit."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part)
        if size >= most:
            pdf = pd.concat(held, ignore_index=True)
            last = int(np.flatnonzero(changed(pdf))[-1]) if changed(pdf).any() else 0
            if last:
                yield pdf.iloc[:last].reset_index(drop=True)
            held, size = [pdf.iloc[last:]], len(pdf) - last
    if size:
        yield pd.concat(held, ignore_index=True)


def walked(views: DataFrame, payload: list[str], key_of, pairs_of, node_rows: int = NODE_ROWS, weight: F.Column | None = None, most: int = WALK_ROWS) -> DataFrame:
    """Spanning edges (a, b) of the pairs that ``pairs_of`` finds in whole units of ``views``, sorted by ``key_of``.

    A task takes many units at a time. Each time gives a star for each group that it joins rather than
    all its pairs, so there are never more edges than rows.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_units(parts, most):
            u = Units(pdf, key_of)
            reps, root = u.pdf["rep"].to_numpy(), forest(len(pdf), pairs_of(u))
            moved = (root != np.arange(len(root))) & (reps != reps[root])
            yield pd.DataFrame({"a": reps[moved], "b": reps[root[moved]]})

    return met(views, payload, node_rows, weight).repartition(*UNIT).sortWithinPartitions(*UNIT).mapInPandas(run, "a long, b long")


#: Byte b of a 64-bit word, then the rest of its quarter, of its half and the other half.
BYTES = tuple((b, b ^ 1, (b ^ 2) & ~1, (b ^ 2) | 1, *((b ^ 4) // 4 * 4 + k for k in range(4))) for b in range(8))


def near_plan(rows: int, leaf_rows: float = 2048) -> tuple[int, list[tuple[int, ...]], Budgets, list[int]]:
    """Depth of the top nodes, the byte order of each view, the budgets, and the flips of a node to those it meets.

    Two words within 4 bits differ in at most 2 bits of one half; in that half there is a quarter with at
    most 1, and in that quarter a byte with none. So eight views, one for each byte, find every pair with
    budgets 0, 1, 2 and 4 at depths 8, 16, 32 and 64. With more rows the top nodes get more levels and meet
    those within the budget; from 17 levels on two views, one for each half, need fewer copies.
    """
    depth = min(32, max(8, top_depth(rows, leaf_rows)))
    if depth <= 16:
        return depth, list(BYTES), ((8, 0), (16, 1), (32, 2), (64, 4)), [0, *(1 << k for k in range(depth - 8))]
    flips = [0, *(1 << k for k in range(depth)), *(1 << k | 1 << m for k in range(depth) for m in range(k))]
    return depth, [BYTES[0], BYTES[4]], ((32, 2), (64, 4)), flips


def near_edges(classes: DataFrame, leaf_rows: float = 2048, node_rows: int = NODE_ROWS) -> DataFrame:
    """Spanning edges (a, b) between the ids of ``classes(fp, rep)`` whose fingerprints are within 4 bits."""
    depth, orders, budgets, flips = near_plan(classes.count(), leaf_rows)
    key = lambda order: reduce(lambda x, y: x.bitwiseOR(y), (F.shiftleft(F.shiftrightunsigned("fp", 56 - 8 * b).bitwiseAND(F.lit(255)), 56 - 8 * k) for k, b in enumerate(order)))
    turns = classes.select("rep", F.posexplode(F.array(*map(key, orders))).alias("turn", "key"))
    node = F.shiftrightunsigned("key", 64 - depth)
    views = turns.select("turn", node.alias("node"), "rep", "key", F.explode(F.array(*(F.lit(f).cast("long") for f in flips))).alias("flip"))
    views = views.select("turn", "node", F.col("node").bitwiseXOR(F.col("flip")).alias("partner"), "rep", "key")
    bit = 55 if depth <= 16 else 63
    return walked(views, ["key"], lambda x: x["key"].to_numpy().view(np.uint64), lambda u: trie_pairs(u.keys, u.start, budgets, bit), node_rows)


def simhash_groups(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): the SimHash of each document and the smallest doc_id that it reaches."""
    fps = written(fingerprints(docs, width), "simhash_fp")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash_class")
    roots = components(near_edges(classes.where("rep is not null")), "simhash_edges")
    labels = classes.join(roots, classes["rep"] == roots["node"], "left").select(F.col("fp").alias("class_fp"), F.coalesce("root", "rep").alias("component_id"))
    return fps.join(labels, F.col("fp") == F.col("class_fp")).select("doc_id", "fp", "component_id")


def simhash_query(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    out = simhash_groups(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- by similarity -------------------------------------------------------------------------------

#: Odd factors that turn the hash of a shingle into those of the further words of a wide fingerprint.
FACTORS = np.array([1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)
WORDS = len(FACTORS)
NAMES = [f"w{k}" for k in range(WORDS)]


def similar_plan(rows: int, leaf_rows: float = 2048) -> tuple[int, int, Budgets]:
    """Depth of the top nodes (all bits equal), number of views, and the budgets within a view.

    At a similarity of 0.8 a bit differs with a chance of 0.15. A view finds such a pair with a chance of
    0.85^depth * 0.9, 0.24 at eight levels; every four levels more halve that, and double the views.
    Together they miss about one pair in 7,000 at exactly 0.8, whatever the number of rows, and fewer above.
    """
    depth = min(24, max(8, top_depth(rows, leaf_rows)))
    return depth, int(np.ceil(32 * 2 ** ((depth - 8) / 4))), ((depth, 0), (depth + 8, 2), (min(60, depth + 24), 10), (64, 24))


def view_keys(words: np.ndarray, turn: int, depth: int) -> np.ndarray:
    """The 64 bits of the wide fingerprints (rows of four uint64) that view ``turn`` walks.

    The views of one lap begin ``depth`` bits apart, so that no two have a bit of their top nodes in
    common; each lap after the first has the 256 bits in another order.
    """
    lap, at = divmod(turn, 64 * WORDS // depth)
    order = np.arange(64 * WORDS) if lap == 0 else np.random.default_rng(lap).permutation(64 * WORDS)
    bits = np.unpackbits(np.ascontiguousarray(words, ">u8").view(np.uint8), axis=1)
    taken = np.ascontiguousarray(bits[:, np.roll(order, -at * depth)[:64]])
    return np.packbits(taken, axis=1).view(">u8").ravel().astype(np.uint64)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the word shingles of a text; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_AZ).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], stops[:-1] + 1))
    pairs = zip(starts[: max(1, len(words) - width + 1)].tolist(), stops[min(width, len(words)) - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e], SEED) for s, e in pairs), np.uint64))


def wide_fingerprint(h: np.ndarray) -> list[int]:
    """A SimHash of 4 * 64 bits over a set of shingles (signed longs)."""
    if not len(h):
        return [0] * WORDS
    out = []
    for f in FACTORS:
        x = h * f
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        bits = np.zeros(64, np.int64)
        for at in range(0, len(x), CHUNK):
            bits += np.unpackbits(x[at : at + CHUNK].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int32)
        out.append(int(np.packbits(2 * bits > len(h)).view(np.int64)[0]))
    return out


def bits_apart(similarity: float) -> int:
    """Differing bits, of all, that a Jaccard similarity of shingle sets leads to, and five deviations more.

    Only candidates are chosen by it, so it may be wide; sets of four or five shingles, whose majorities
    are often ties, need the fifth deviation.
    """
    cosine = 2 * similarity / (1 + similarity)
    share, n = np.arccos(cosine) / np.pi, 64 * WORDS
    return int(n * share + 5 * np.sqrt(n * share * (1 - share)))


def wide_words(pdf: pd.DataFrame) -> np.ndarray:
    return np.ascontiguousarray(pdf[NAMES].to_numpy(np.int64)).view(np.uint64)


def similar_views(classes: DataFrame, depth: int, turns: list[int]) -> DataFrame:
    """A row (turn, node, partner = node, and all columns) for each of ``classes`` and each of the views."""
    names = classes.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            words = wide_words(pdf)
            for turn in turns:
                node = (view_keys(words, turn, depth) >> np.uint64(64 - depth)).astype(np.int64)
                yield pdf.assign(turn=np.int32(turn), node=node, partner=node)

    return classes.mapInPandas(run, "turn int, node long, partner long, " + ", ".join(f"{n} long" for n in names))


def alike(rows: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]], limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Those of the pairs of ``rows`` (wide fingerprints) that differ in at most ``limit`` bits."""
    for i, j in pairs:
        for at in range(0, len(i), 1 << 18):
            x, y = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
            ok = np.bitwise_count(rows[x] ^ rows[y]).sum(axis=1, dtype=np.int64) <= limit
            if ok.any():
                yield x[ok], y[ok]


def similar_edges(classes: DataFrame, similarity: float = 0.8, leaf_rows: float = 2048, node_rows: int = NODE_ROWS) -> DataFrame:
    """Spanning edges (a, b) between ids of ``classes(w0 .. w3, rep)`` of all pairs that may have this similarity.

    A pair counts if a walk finds it in some view (:func:`similar_plan`) and the whole fingerprints differ
    in at most :func:`bits_apart` bits.
    """
    limit = bits_apart(similarity)
    depth, views, budgets = similar_plan(classes.count(), leaf_rows)

    def keys(pdf: pd.DataFrame) -> np.ndarray:
        words, turn, out = wide_words(pdf), pdf["turn"].to_numpy(), np.empty(len(pdf), np.uint64)
        for t in np.unique(turn):
            out[turn == t] = view_keys(words[turn == t], int(t), depth)
        return out

    rows = similar_views(classes.select("rep", *NAMES), depth, list(range(views)))
    return walked(rows, NAMES, keys, lambda u: alike(wide_words(u.pdf), trie_pairs(u.keys, u.start, budgets, 63 - depth), limit), node_rows)


#: Shingles that one unit of the exact comparison takes, and rows that a task compares together.
UNIT_SHINGLES = 1 << 20
EXACT_ROWS = 1 << 12
#: Bytes of a bit matrix (rows x shared shingles); beyond it pairs are compared set by set.
MATRIX_BYTES = 64 << 20


class Sets:
    """The shingle sets of a unit's rows, as bits of those shingles that more than one row has."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.sizes = sets, np.array([len(x) for x in sets])
        row = np.repeat(np.arange(len(sets)), self.sizes)
        _, own, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count > 1
        column = (np.cumsum(shared) - 1)[own]
        width = -(-int(shared.sum()) // 64) * 8
        self.bits = None
        if len(sets) * width <= MATRIX_BYTES:
            bits = np.zeros((len(sets), width), np.uint8)
            kept = shared[own]
            row, column = row[kept], column[kept]
            np.bitwise_or.at(bits, (row, column >> 3), np.left_shift(1, column & 7).astype(np.uint8))
            self.bits = bits.view(np.uint64)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of the sets of rows i and j."""
        if self.bits is None:
            return np.array([len(np.intersect1d(self.sets[x], self.sets[y], assume_unique=True)) for x, y in zip(i, j, strict=True)], np.int64)
        out, step = np.empty(len(i), np.int64), max(1, (1 << 22) // max(1, self.bits.shape[1]))
        for at in range(0, len(i), step):
            out[at : at + step] = np.bitwise_count(self.bits[i[at : at + step]] & self.bits[j[at : at + step]]).sum(axis=1, dtype=np.int64)
        return out


def truly_similar(u: Units, similarity: float, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of each unit whose shingle sets have this Jaccard similarity or more."""
    sets, rows = u.pdf["shingles"].to_numpy(), wide_words(u.pdf)
    for k in range(len(u.start[0])):
        start = tuple(x[k : k + 1] for x in u.start)
        first, held = int(start[0][0]), None
        for i, j in alike(rows, trie_pairs(u.keys, start, ((64, 64),)), limit):
            held = held or Sets(list(sets[first : int(start[3][0])]))
            common = held.common(i - first, j - first)
            sizes = held.sizes[i - first] + held.sizes[j - first]
            ok = common >= similarity * (sizes - common)
            if ok.any():
                yield i[ok], j[ok]


def confirmed_edges(docs: DataFrame, classes: DataFrame, similarity: float = 0.8, width: int = 5, unit_shingles: int = UNIT_SHINGLES) -> DataFrame:
    """(a, b) that link the ids of ``classes(w0 .. w3, rep)`` as all candidates of exact similarity or more do.

    The walk's candidates are joined to clusters first, by spanning edges, never by all pairs. The shingle
    sets of each cluster's rows then meet in tasks of bounded size (a large cluster is cut into blocks that
    meet pairwise) and are compared there; again only spanning edges leave the task.
    """
    limit = bits_apart(similarity)
    clusters = components(written(similar_edges(classes, similarity), "simhash_candidates"), "simhash_edges")
    named = clusters.select(F.col("node").alias("id"), "root").unionByName(clusters.select(F.col("root").alias("id"), "root").distinct())
    texts = columns_of(docs, "doc_id", "text").join(named, F.col("doc_id") == F.col("id"))

    def sets(texts: list[str | None]) -> list:
        found = [shingle_set(t, width) for t in texts]
        return [[x.view(np.int64) for x in found], *map(list, zip(*(wide_fingerprint(x) for x in found), strict=True))] if texts else [[]] * (1 + WORDS)

    rows = written(map_texts(texts, sets, "shingles array<long>, " + ", ".join(f"{n} long" for n in NAMES), keep=("doc_id", "root")), "simhash_sets")
    # Of rows with an equal doc_id only those count whose text is that of the class.
    own = [F.col(n) == F.col(f"c_{n}") for n in NAMES]
    rows = rows.join(classes.select(F.col("rep"), *(F.col(n).alias(f"c_{n}") for n in NAMES)), [F.col("doc_id") == F.col("rep"), *own])
    views = rows.select(F.lit(0).alias("turn"), F.col("root").alias("node"), F.col("root").alias("partner"), "rep", "shingles", *NAMES)
    return walked(views, ["shingles", *NAMES], lambda pdf: wide_words(pdf)[:, 0], lambda u: truly_similar(u, similarity, limit), unit_shingles, F.size("shingles"), EXACT_ROWS)


def similar_groups(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """(doc_id, component_id): groups of documents linked by shingle sets of this Jaccard similarity; equal sets are one class."""
    wide = map_texts(docs, lambda texts: list(map(list, zip(*(wide_fingerprint(shingle_set(t, width)) for t in texts), strict=True))) or [[]] * WORDS, ", ".join(f"{n} long" for n in NAMES))
    wide = written(wide, "simhash_wide")
    classes = written(wide.groupBy(*NAMES).agg(F.min("doc_id").alias("rep")), "simhash_wide_class")
    roots = components(confirmed_edges(docs, classes.where("rep is not null"), similarity, width), "simhash_edges")
    labels = classes.join(roots, classes["rep"] == roots["node"], "left").select(*(F.col(n).alias(f"c_{n}") for n in NAMES), F.coalesce("root", "rep").alias("component_id"))
    match = [F.col(n) == F.col(f"c_{n}") for n in NAMES]
    return wide.join(labels, match).select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """The document with the smallest doc_id of every near-duplicate group, with all its columns.

    A document whose doc_id is null cannot be named by a group and stays; of rows with an equal doc_id
    each stays if one does.
    """
    keep = similar_groups(docs.where("doc_id is not null"), similarity, width).where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(keep, docs["doc_id"] == keep["kept_id"], "left_semi").unionByName(docs.where("doc_id is null"))
