"""Katz backoff language model of order two: Good-Turing discounts, exactly normalised backoff weights.

p(w | h) is d(c) * c(h w) / c(h) for bigrams seen in training and alpha(h) * p(w) for the others;
p(w) = (c + 0.5) / (N + 0.5 * (V + 1)), all unknown words sharing one type. Counts up to 5 are
discounted after Good-Turing (Katz), alpha(h) gives the mass that is left to the words not seen after h,
so that every context sums to one; a context without any discounted count gets one more count to
leave. Contexts never seen back off whole. A text starts from a context of its own and stops with an end token.

How it is spread: documents are read once, in blocks of about 8 MB of text, whose tokens are kept as
numbers of the block's sorted vocabulary. Three exchanges follow, each of columns packed by block and
bucket: words to their bucket (which counts and numbers them) and back; bigrams to the bucket of their
context (which counts them, and gives the discounts and weights) and back. A context with more than a
bucket's share of all tokens is dealt out by word to as many buckets as it has shares; the sums of its
parts are added up and joined to those buckets alone. Only pieces that hold something are rows, so their
number is bounded by that of the distinct bigrams of the blocks; a bucket's expected size stays the same
at every input size. Blocks are handled one at a time.

What is kept: :func:`fitted` writes the model by bucket, a table of words (hash, count) and a table of
contexts (word, count, denominator, backoff weight), and :func:`score_texts` scores any texts from them
by the same exchanges, without the training texts.

Defined results: a null or wordless text is its end token; a very long text is a block of its own; a null
doc_id is in training; rows with equal doc_id are scored each; ties don't arise; without training rows all
words are unknown and the model is its unigram part; an empty table gives an empty result; further
columns are ignored, whatever their names. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibron.llm.common import LOWER_AZ, columns_of, written

BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 8 << 20
END = b" "  # no word is a space
START = np.int64(1) << np.int64(62)
MOST = 5  # counts up to this are discounted


def held_out_col() -> F.Column:
    """Whether crc32 of the doc_id as text leaves 1 on division by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))


def pack(values: np.ndarray) -> bytes:
    """Whole numbers >= 0, compressed by byte planes."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(np.asarray(values).astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(packed: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel().view(np.int64)


def rises(values: np.ndarray) -> np.ndarray:
    """Differences of a sorted array, the first from zero (modulo 2**64)."""
    return np.diff(values.view(np.uint64), prepend=np.uint64(0)).view(np.int64) if len(values) else values


def summed(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps.view(np.uint64)).view(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[list, list, list]]:
    ids, texts, held, size = [], [], [], 0
    for batch in batches:
        for i, t, h in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("held").to_pylist(), strict=True):
            ids.append(i)
            texts.append(t)
            held.append(h)
            size += len(t or "")
            if size >= block_bytes:
                yield ids, texts, held
                ids, texts, held, size = [], [], [], 0
    if ids:
        yield ids, texts, held


BLOCK = "kind string, block long, bucket int, a binary, b binary, ids array<long>, held array<boolean>"


def read_blocks(docs: DataFrame, buckets: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each block of ``docs(doc_id, text, held)`` one row of its tokens (a), document lengths (b) and
    documents; and for each bucket of hashes that it has words of, these (a) with their counts in training (b)."""
    shift = np.uint64(64 - int(np.log2(buckets)))

    def run(batches):
        part = TaskContext.get().partitionId()
        for seq, (ids, texts, held) in enumerate(_blocks(batches, block_bytes)):
            number: dict[bytes, int] = {END: 0}
            put = number.setdefault
            tokens, lengths = [], []
            for text in texts:
                words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_AZ).split()
                t = np.fromiter((put(w, len(number)) for w in words), np.int32, len(words))
                tokens += [t, np.zeros(1, np.int32)]
                lengths.append(len(words) + 1)
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
            order = np.argsort(hashes)
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            hashes = hashes[order]
            idx = rank[np.concatenate(tokens)]
            train = np.repeat(~np.array(held, bool), lengths)
            count = np.bincount(idx[train], minlength=len(hashes))
            block = part << 24 | seq
            own, first = np.unique(hashes >> shift, return_index=True)
            rows = [("tokens", block, 0, pack(idx), pack(np.array(lengths)), ids, held)]
            rows += [("words", block, int(k), pack(rises(hashes[x:y].view(np.int64))), pack(count[x:y]), None, None) for k, x, y in zip(own, first, [*first[1:], len(hashes)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_())), strict=True)], names=["kind", "block", "bucket", "a", "b", "ids", "held"])

    return docs.select("doc_id", "text", "held").mapInArrow(run, BLOCK)


def columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


WORDS = "kind string, block long, bucket int, a binary, b binary, n long, v long"


def word_answers(asks: pd.DataFrame, known: np.ndarray, count: np.ndarray) -> list[tuple]:
    """For each block that asks a bucket the numbers of its words in the bucket and their counts.

    The k-th known word has number 2 k + 1; words in the gap before it, all unknown, share number 2 k.
    """
    out, padded, counts = [], np.append(known, 0), np.append(count, 0)
    for block, bucket, a in zip(asks["block"], asks["bucket"], asks["a"], strict=True):
        h = summed(unpack(a)).view(np.uint64)
        at = np.searchsorted(known, h)
        met = (padded[at] == h) & (at < len(known))
        out.append(("answer", block, bucket, pack(rises(2 * at + met)), pack(np.where(met, counts[at], 0)), 0, 0))
    return out


def count_words(pdf: pd.DataFrame) -> pd.DataFrame:
    """The answers of a bucket of words to its blocks; and the bucket's own row, all its words (a) with their
    counts in training (b), the sum of these (n) and how many words are known (v)."""
    hashes = [summed(unpack(a)).view(np.uint64) for a in pdf["a"]]
    known, own = np.unique(np.concatenate(hashes), return_inverse=True)
    count = np.bincount(own, weights=np.concatenate([unpack(b) for b in pdf["b"]])).astype(np.int64)
    model = ("model", -1, int(pdf["bucket"].iloc[0]), pack(rises(known.view(np.int64))), pack(count), int(count.sum()), int((count > 0).sum()))
    return pd.DataFrame([model, *word_answers(pdf, known, count)], columns=columns(WORDS))


def look_up_words(asks: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    """As :func:`count_words`, from a bucket's own row."""
    known = summed(unpack(model["a"].iloc[0])).view(np.uint64) if len(model) else np.zeros(0, np.uint64)
    count = unpack(model["b"].iloc[0]) if len(model) else np.zeros(0, np.int64)
    return pd.DataFrame(word_answers(asks, known, count), columns=columns(WORDS))


def dealt(h_id: np.ndarray, h_count: np.ndarray, w_id: np.ndarray, hot: int, buckets: int) -> np.ndarray:
    """The bucket of a bigram: its context's, or one of as many as the context has shares of ``hot`` tokens."""
    shares = np.maximum(1, -(-h_count // hot)).astype(np.uint64)
    mixed = w_id.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return _bucket(h_id, (mixed >> np.uint64(32)) % shares, buckets)


def _bucket(h_id: np.ndarray, share: np.ndarray, buckets: int) -> np.ndarray:
    mixed = (h_id.view(np.uint64) + share * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


class Bigrams:
    """The distinct bigrams of a block, by bucket."""

    def __init__(self, row, buckets: int, hot: int):
        words = sorted(row["words"], key=lambda w: w["bucket"])
        self.ids = np.concatenate([(np.int64(w["bucket"]) << np.int64(32)) | summed(unpack(w["a"])) for w in words])
        self.count = np.concatenate([unpack(w["b"]) for w in words])
        self.tokens, self.lengths = unpack(row["a"]).astype(np.int32), unpack(row["b"])
        self.starts = np.cumsum(self.lengths) - self.lengths
        n = len(self.ids)
        end = self.tokens[self.lengths[0] - 1]
        pair = np.empty(len(self.tokens), np.int64)
        pair[1:] = self.tokens[:-1]
        pair[self.starts] = n
        pair *= n + 1
        pair += self.tokens
        pair, own = np.unique(pair, return_inverse=True)
        self.own = own.astype(np.int32)
        self.h, self.w = pair // (n + 1), (pair % (n + 1)).astype(np.int32)
        self.h_ids, self.h_count = np.append(self.ids, START), np.append(self.count, self.count[end])
        bucket = dealt(self.h_ids[self.h], self.h_count[self.h], self.ids[self.w], hot, buckets)
        self.order = np.argsort(bucket, kind="stable")
        self.buckets, first = np.unique(bucket[self.order], return_index=True)
        self.cuts = np.append(first, len(bucket))

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The bigrams of the k-th of ``buckets``, and where in them each context begins."""
        mine = self.order[self.cuts[k] : self.cuts[k + 1]]
        return mine, np.flatnonzero(np.diff(self.h[mine], prepend=-1))


def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of Arrow batches; only one at a time becomes Python objects."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


BIGRAMS = "block long, pairs int, h binary, size binary, w binary, seen binary, ch binary, cw binary"


def ask_bigrams(rows: DataFrame, buckets: int, hot: int) -> DataFrame:
    """For each block and bucket its contexts (h, with size bigrams and the count ch each) and their words
    (w, with the count cw and how often the block's training documents have the bigram: seen)."""
    types = (pa.int64(), pa.int32(), *[pa.binary()] * 6)

    def run(batches):
        for row in one_by_one(batches):
            b = Bigrams(row, buckets, hot)
            train = np.repeat(~np.array(row["held"], bool), b.lengths)
            seen = np.bincount(b.own, weights=train).astype(np.int64)
            out = []
            for k, bucket in enumerate(b.buckets.tolist()):
                mine, first = b.runs(k)
                w = b.ids[b.w[mine]]
                steps = np.diff(w, prepend=0)
                steps[first] = w[first]
                h = b.h[mine][first]
                out.append((row["block"], bucket, pack(rises(b.h_ids[h])), pack(np.diff(np.append(first, len(mine)))), pack(steps), pack(seen[mine]), pack(b.h_count[h]), pack(b.count[b.w[mine]])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=columns(BIGRAMS))

    return rows.mapInArrow(run, BIGRAMS)


def words_of(w: bytes, size: np.ndarray) -> np.ndarray:
    """The words of a bucket's contexts from their rises within each context."""
    total = np.cumsum(steps := unpack(w))
    begin = np.cumsum(size) - size
    return total - np.repeat(total[begin] - steps[begin], size)


SUMS = tuple(f"n{r}" for r in range(1, MOST + 2)) + ("rest", "p")


class Bucket:
    """All bigrams of one bucket of ``asks``, with their counts and the sums of their contexts."""

    def __init__(self, asks: pd.DataFrame, unigram: tuple[int, int]):
        self.sizes, self.begin, hs, ws, cw, ch = [], [], [], [], [], []
        for h, size, w, c, x in zip(asks["h"], asks["size"], asks["w"], asks["cw"], asks["ch"], strict=True):
            h, size = summed(unpack(h)), unpack(size)
            hs.append(np.repeat(h, size))
            ws.append(words_of(w, size))
            cw.append(unpack(c).astype(np.float64))
            ch.append(np.repeat(unpack(x), size))
            self.sizes.append(len(ws[-1]))
            self.begin.append(np.cumsum(size) - size)
        none = [np.zeros(0, np.int64)]
        self.h, self.own_h = np.unique(np.concatenate(hs or none), return_inverse=True)
        w, own_w = np.unique(np.concatenate(ws or none), return_inverse=True)
        del hs, ws
        pair, at, self.own = np.unique(self.own_h * np.int64(len(w)) + own_w, return_index=True, return_inverse=True)
        del own_w
        self.count = np.bincount(self.own, weights=np.concatenate([unpack(s) for s in asks["seen"]] or none), minlength=len(pair)).astype(np.int64)
        self.ch = np.zeros(len(self.h), np.int64)
        self.ch[self.own_h] = np.concatenate(ch or none)
        self.context, self.w = pair // max(1, len(w)), w[pair % max(1, len(w))]
        n, v = unigram
        p = (np.concatenate(cw or none)[at] + 0.5) / (n + 0.5 * (v + 1))
        sums = [np.bincount(self.context, weights=self.count == r, minlength=len(self.h)) for r in range(1, MOST + 2)]
        rest = np.bincount(self.context, weights=np.where(self.count > MOST, self.count, 0), minlength=len(self.h))
        self.sums = np.stack([*sums, rest, np.bincount(self.context, weights=np.where(self.count > 0, p, 0), minlength=len(self.h))], axis=1)


def bucket_sums(asks: pd.DataFrame, unigram: tuple[int, int], hot: int) -> pd.DataFrame:
    """Counts of counts of a bucket (h = -1), and the sums of those of its contexts that other buckets share."""
    b = Bucket(asks, unigram)
    shared = b.ch > hot
    rows = np.concatenate((b.sums.sum(axis=0, keepdims=True), b.sums[shared]))
    return pd.DataFrame({"h": np.concatenate(([-1], b.h[shared])), "ch": np.concatenate(([0], b.ch[shared])), **dict(zip(SUMS, rows.T, strict=True))})


def to_shares(totals: DataFrame, buckets: int, hot: int) -> DataFrame:
    """A row for each bucket that has a share of a context of ``totals(h, ch, sums)``; h = -1 goes to every bucket.

    There are at most three times as many rows as buckets: a shared context has more than ``hot`` tokens.
    """
    names = ["h", "ch", *SUMS]

    def run(parts):
        for pdf in parts:
            of_all = pdf["h"] < 0
            for row in pdf[of_all].itertuples(index=False):
                yield pd.DataFrame({"pairs": np.arange(buckets, dtype=np.int32), **{k: getattr(row, k) for k in names}})
            pdf = pdf[~of_all]
            shares = -(-pdf["ch"].to_numpy() // hot)
            rows = pdf.loc[pdf.index.repeat(shares), names]
            share = np.arange(len(rows)) - np.repeat(np.cumsum(shares) - shares, shares)
            yield rows.assign(pairs=_bucket(rows["h"].to_numpy(), share.astype(np.uint64), buckets).astype(np.int32)).drop_duplicates(["pairs", "h"])[["pairs", *names]]

    return totals.mapInPandas(run, "pairs int, h long, ch long, " + ", ".join(f"{k} double" for k in SUMS))


def discounts(n: np.ndarray) -> np.ndarray:
    """d(0) .. d(MOST + 1) from the numbers n[0] .. n[MOST] of bigrams seen once, twice, ...

    Where Good-Turing gives no factor between 0 and 1 (small or odd data), (r - 0.5) / r stands in.
    """
    d = np.ones(MOST + 2)
    with np.errstate(all="ignore"):
        common = (MOST + 1) * n[MOST] / n[0]
        for r in range(1, MOST + 1):
            x = ((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common)
            d[r] = x if np.isfinite(x) and 0 < x < 1 else (r - 0.5) / r
    return d


PAIRS = "kind string, block long, pairs int, h binary, size binary, w binary, count binary, more binary, alpha binary, d array<double>"


def doubles(x: np.ndarray) -> bytes:
    return pack(x.view(np.int64))


def answer_bigrams(asks: pd.DataFrame, shared: pd.DataFrame, unigram: tuple[int, int], hot: int) -> pd.DataFrame:
    """For each block of a bucket the counts of its bigrams, and of its contexts what the denominator has more
    than their count and the backoff weight (zero where the block doesn't need it); and the bucket's own row:
    its contexts (h, with size words each) and their words (w), with the same of all of these."""
    b = Bucket(asks, unigram)
    of_all = shared["h"] == -1
    d = discounts(shared.loc[of_all, list(SUMS[: MOST + 1])].to_numpy(float)[0])
    shared = shared[~of_all].sort_values("h")
    h = np.union1d(b.h, shared["h"].to_numpy(np.int64))
    ch, sums = np.zeros(len(h), np.int64), np.zeros((len(h), len(SUMS)))
    place = np.searchsorted(h, b.h)
    ch[place], sums[place] = b.ch, b.sums
    at = np.searchsorted(h, shared["h"].to_numpy(np.int64))
    ch[at], sums[at] = shared["ch"].to_numpy(np.int64), shared[list(SUMS)].to_numpy(float)
    kept = (sums[:, :MOST] * np.arange(1, MOST + 1) * d[1 : MOST + 1]).sum(axis=1) + sums[:, MOST + 1]
    left = ch - kept
    more = left < 1e-6
    below = ch + more
    alpha = np.where(more, 1.0, left) / np.maximum(below, 1) / (1 - sums[:, -1])
    pairs = int((asks if len(asks) else shared)["pairs"].iloc[0]) if len(asks) or len(shared) else -1
    if pairs < 0:
        return pd.DataFrame([], columns=columns(PAIRS))
    out, begun = [], 0
    for block, size, begin in zip(asks["block"], b.sizes, b.begin, strict=True):
        mine = slice(begun, begun + size)
        count, own = b.count[b.own[mine]], place[b.own_h[mine][begin]]
        needed = np.add.reduceat(count == 0, begin) > 0
        out.append(("answer", block, pairs, None, None, None, pack(count), pack(more[own]), doubles(np.where(needed, alpha[own], 0.0)), d.tolist()))
        begun += size
    seen = b.count > 0
    context, w = place[b.context[seen]], b.w[seen]
    size = np.bincount(context, minlength=len(h))
    known = ch > 0
    steps = np.diff(w, prepend=0)
    first = (np.cumsum(size) - size)[size > 0]
    steps[first] = w[first]
    out.append(("model", -1, pairs, pack(rises(h[known])), pack(size[known]), pack(steps), pack(b.count[seen]), pack(more[known]), doubles(alpha[known]), d.tolist()))
    return pd.DataFrame(out, columns=columns(PAIRS))


def look_up_bigrams(asks: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    """As :func:`answer_bigrams`, from a bucket's own row."""
    out = []
    m = model.iloc[0] if len(model) else None
    h = summed(unpack(m["h"])) if len(model) else np.zeros(0, np.int64)
    size = unpack(m["size"]) if len(model) else h
    more, alpha = (unpack(m["more"]), unpack(m["alpha"]).view(np.float64)) if len(model) else (h, h.astype(float))
    counts = np.append(unpack(m["count"]), 0) if len(model) else np.zeros(1, np.int64)
    d = list(m["d"]) if len(model) else [1.0] * (MOST + 2)
    begin = np.cumsum(size) - size
    w = np.zeros(0, np.int64)
    if size.sum():
        total, steps = np.cumsum(s := unpack(m["w"])), s
        w = total - np.repeat((total - steps)[begin[size > 0]], size[size > 0])
    names, own = np.unique(w, return_inverse=True)
    key = np.repeat(np.arange(len(h)), size) * np.int64(len(names) + 1) + own
    for block, pairs, ah, asize, aw in zip(asks["block"], asks["pairs"], asks["h"], asks["size"], asks["w"], strict=True):
        ah, asize = summed(unpack(ah)), unpack(asize)
        aw = words_of(aw, asize)
        at = np.searchsorted(h, ah)
        met = np.append(h, -1)[at] == ah
        wat = np.searchsorted(names, aw)
        wmet = (np.append(names, -1)[wat] == aw) & np.repeat(met, asize)
        asked = np.repeat(at, asize) * np.int64(len(names) + 1) + wat
        place = np.searchsorted(key, asked)
        found = wmet & (np.append(key, -1)[place] == asked)
        out.append(("answer", block, pairs, None, None, None, pack(np.where(found, counts[np.where(found, place, 0)], 0)), pack(np.where(met, np.append(more, 0)[at], 0)), doubles(np.where(met, np.append(alpha, 0.0)[at], 0.0)), d))
    return pd.DataFrame(out, columns=columns(PAIRS))


def score_blocks(rows: DataFrame, buckets: int, hot: int, unigram: tuple[int, int]) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of all documents of ``rows`` (tokens, words, answers)."""
    n, v = unigram

    def run(batches):
        for row in one_by_one(batches):
            b = Bigrams(row, buckets, hot)
            log_p = np.log10((b.count + 0.5) / (n + 0.5 * (v + 1)))
            log_pair = np.zeros(len(b.h))
            place = {k: at for at, k in enumerate(b.buckets.tolist())}
            for answer in row["answers"]:
                mine, first = b.runs(place[answer["pairs"]])
                count, d = unpack(answer["count"]), np.array(answer["d"])
                size = np.diff(np.append(first, len(mine)))
                ch = b.h_count[b.h[mine]]
                below = ch + np.repeat(unpack(answer["more"]), size)
                alpha = np.repeat(unpack(answer["alpha"]).view(np.float64), size)
                with np.errstate(divide="ignore"):
                    direct = np.log10(d[np.minimum(count, MOST + 1)] * count / np.maximum(below, 1))
                    backed = np.where(ch > 0, np.log10(alpha), 0.0) + log_p[b.w[mine]]
                log_pair[mine] = np.where(count > 0, direct, backed)
            total = lambda x: np.add.reduceat(x, b.starts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(b.lengths), pa.array(total((b.count[b.tokens] > 0).astype(np.int64))), pa.array(total(log_p[b.tokens])), pa.array(total(log_pair[b.own]))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
            )

    return rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


class Model(NamedTuple):
    """A written model: ``words`` by bucket, ``contexts`` by bucket, and the numbers that both go by."""

    words: DataFrame
    contexts: DataFrame
    buckets: int
    hot: int
    tokens: int
    types: int


def _numbered(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """The blocks' token rows, each with the numbers and counts of its words."""
    numbers = words.where("kind = 'answer'").groupBy("block").agg(F.collect_list(F.struct("bucket", "a", "b")).alias("words"))
    return blocks.where("kind = 'tokens'").select("block", "a", "b", "ids", "held").join(numbers, "block")


def _scored(known: DataFrame, answers: DataFrame, model: Model) -> DataFrame:
    answered = answers.where("kind = 'answer'").groupBy("block").agg(F.collect_list(F.struct("pairs", "count", "more", "alpha", "d")).alias("answers"))
    return score_blocks(known.join(answered, "block"), model.buckets, model.hot, (model.tokens, model.types))


def trained(docs: DataFrame, block_bytes: int = BLOCK_BYTES, hot: int | None = None) -> tuple[Model, DataFrame]:
    """The model of the rows of ``docs(doc_id, text, held)`` that aren't held, and the scores of all rows.

    A context of more than ``hot`` tokens is shared out (by default: a bucket's share, 1000 at least).
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 << max(6, int(np.ceil(np.log2(1 + size / BUCKET_BYTES))))

    blocks = written(read_blocks(docs, buckets, block_bytes), "katz_blocks", ["kind"])
    words = written(blocks.where("kind = 'words'").select("block", "bucket", "a", "b").groupBy("bucket").applyInPandas(count_words, WORDS), "katz_words", ["kind"])
    totals = words.where("kind = 'model'").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    unigram = (totals["n"] or 0, totals["v"] or 0)
    hot = hot or max(1000, unigram[0] // buckets)
    known = _numbered(blocks, words)

    asked = ask_bigrams(known.drop("ids"), buckets, hot).repartition("pairs")
    sums = asked.groupBy("pairs").applyInPandas(lambda pdf: bucket_sums(pdf, unigram, hot), "h long, ch long, " + ", ".join(f"{k} double" for k in SUMS))
    totals = sums.groupBy("h").agg(F.max("ch").alias("ch"), *(F.sum(k).alias(k) for k in SUMS))
    shared = to_shares(totals, buckets, hot)
    answers = asked.groupBy("pairs").cogroup(shared.groupBy("pairs")).applyInPandas(lambda a, s: answer_bigrams(a, s, unigram, hot), PAIRS)
    pairs = written(answers, "katz_bigrams", ["kind"])
    model = Model(words.where("kind = 'model'"), pairs.where("kind = 'model'"), buckets, hot, *unigram)
    return model, _scored(known, pairs, model)


def fitted(docs: DataFrame) -> Model:
    """The model of all rows of ``docs(doc_id, text)``, written to the shared folder."""
    return trained(columns_of(docs, "doc_id", "text").withColumn("held", F.lit(False)))[0]


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of all rows of ``docs(doc_id, text)`` under a written model."""
    docs = columns_of(docs, "doc_id", "text").withColumn("held", F.lit(True))
    blocks = written(read_blocks(docs, model.buckets), "katz_blocks", ["kind"])
    asks = blocks.where("kind = 'words'").select("block", "bucket", "a", "b")
    by_bucket = lambda asks, own: look_up_words(asks, own) if len(asks) else pd.DataFrame([], columns=columns(WORDS))
    words = written(asks.groupBy("bucket").cogroup(model.words.groupBy("bucket")).applyInPandas(by_bucket, WORDS), "katz_words")
    known = _numbered(blocks, words)
    answers = ask_bigrams(known.drop("ids"), model.buckets, model.hot).groupBy("pairs").cogroup(model.contexts.groupBy("pairs")).applyInPandas(look_up_bigrams, PAIRS)
    return _scored(known, written(answers, "katz_bigrams"), model).drop("held_out")


def katz_query(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    model, scores = trained(columns_of(docs, "doc_id", "text").withColumn("held", held_out_col()))
    return scores.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
