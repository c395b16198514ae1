"""Removal of repeated byte strings by bucket-pointer refinement of suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier (smaller doc_id, or the
same document further left). Suffixes are grouped to that depth only:

* initial buckets: every window of LENGTH bytes is represented by its smallest q-gram (q = 32), so equal
  windows meet in the bucket of the same q-gram at the same distance. About one suffix in 35 is such an
  anchor; a bucket of one suffix is finished at once;
* refinement: bucket identifiers of 4 bytes at two offsets give those of 8 bytes, these again those of
  16, and so on up to 100 (each round reuses the identifiers of the last). Anchors are sorted on bucket,
  then on the identifiers of the two windows that span all that the anchor represents. All but the first
  of equal anchors are repeats as a whole, whatever their number;
* what is left, the first anchors of buckets that the refinement has split (the ends of repeats), is
  refined once more, window by window, in which all but the first of equal windows are repeats. For that
  the few bytes that such an anchor spans move to its bucket; buckets of very many different anchors are
  dealt out by window instead, so that no bucket has to fit into one task.

Identifiers are 64-bit mixes of the content and are compared within a bucket only, so two of them
(128 bits) have to agree.

Defined results: a null text is an empty document; documents under 100 bytes stay whole; a long run of
one byte keeps its first byte and loses the rest if it has over 100; if doc_ids are null or repeat, the
rows are numbered by (doc_id, text) instead, nulls first, so that a repeated row is a later document;
an empty table gives an empty result. Texts are handled in pieces of 4 MB.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibron.llm.common import TEXTS_AT_ONCE, columns_of, written

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
PLACE_BITS = np.uint64(28)
PLACE = np.uint64((1 << 28) - 1)
#: Bytes of a document that are handled at once; the pieces overlap by a window.
PIECE = 1 << 22


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Identifiers of what the identifiers a and b stand for side by side."""
    x = a * M1 + (b ^ (b >> np.uint64(29))) * M2
    x ^= x >> np.uint64(32)
    x *= M3
    x ^= x >> np.uint64(31)
    return x


def identifiers(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket identifiers of all suffixes at depth 32 and at depth 100, by doubling."""
    b = raw.astype(np.uint64)
    ids = b[:-3] | b[1:-2] << np.uint64(8) | b[2:-1] << np.uint64(16) | b[3:] << np.uint64(24)
    for depth in (4, 8, 16):
        ids = _join(ids[:-depth], ids[depth:])
    deep = _join(ids[:-GRAM], ids[GRAM:])  # depth 64
    return ids, _join(deep[: -(LENGTH - 64)], deep[LENGTH - 64 :])


def anchors(raw: np.ndarray) -> tuple[np.ndarray, ...]:
    """(place, key, wide, first, last): the anchors of a text of at least LENGTH bytes, and the range of
    windows that each represents; wide tells what all of these windows hold."""
    gram, window = identifiers(raw)
    v = (gram & ~PLACE) | np.arange(len(gram), dtype=np.uint64)
    step = 1
    while 2 * step <= SPAN:
        v = np.minimum(v[:-step], v[step:])
        step *= 2
    if step < SPAN:
        v = np.minimum(v[: len(v) - (SPAN - step)], v[SPAN - step :])
    at = (v & PLACE).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
    last = np.append(first[1:], len(at)) - 1
    place = at[first]
    shape = ((place - first) * 256 + (last - first)).astype(np.uint64)
    return place, gram[place], _join(_join(window[first], window[last]), shape), first, last


def _pieces(raw: np.ndarray):
    """(offset, bytes) pieces of a text, overlapping so that every window is in one of them."""
    for at in range(0, max(0, len(raw) - LENGTH + 1), PIECE):
        yield at, raw[at : at + PIECE + LENGTH - 1]


def _raw(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _batch(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def _gathered(parts: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
    return _batch({k: np.concatenate([p[k] for p in parts]) for k in parts[0]})


def _salts(rows: dict[str, np.ndarray]) -> np.ndarray:
    """Zero for the first of the equal anchors among these rows, another number for each of the others."""
    order = np.lexsort((rows["place"], rows["uid"], rows["wide"], rows["key"]))
    again = np.zeros(len(order), bool)
    again[order[1:]] = (rows["key"][order[1:]] == rows["key"][order[:-1]]) & (rows["wide"][order[1:]] == rows["wide"][order[:-1]])
    return np.where(again, rows["uid"] * 1_000_003 + rows["place"] + 1 | 1, 0)


def anchor_rows(docs: DataFrame) -> DataFrame:
    """(uid, key, wide, place, first, last, salt) of all anchors of ``docs(uid, text)``, in the scan's own tasks.

    Anchors that an equal one precedes among the documents at hand are repeats already; their salt keeps
    them out of the bucket, so that a string with a third of all rows doesn't meet in one task.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                found = []
                for uid, text in zip(part.column("uid").to_pylist(), part.column("text").to_pylist(), strict=True):
                    for offset, raw in _pieces(_raw(text)):
                        place, key, wide, first, last = anchors(raw)
                        found.append({"uid": np.full(len(place), uid, np.int64), "key": key.view(np.int64), "wide": wide.view(np.int64), "place": place + offset, "first": (place - first).astype(np.int16), "last": (place - last).astype(np.int16)})
                if found:
                    rows = {k: np.concatenate([p[k] for p in found]) for k in found[0]}
                    yield _batch({**rows, "salt": _salts(rows)})

    return docs.select("uid", "text").mapInArrow(run, "uid long, key long, wide long, place long, first short, last short, salt long")


def refined(rows: DataFrame) -> DataFrame:
    """The anchors that matter: repeats as a whole (rep false), and the first ones of split buckets (rep true).

    first and last are the distances from the first and last window's start to the anchor; classes counts
    the different anchors of the bucket.
    """
    bucket = Window.partitionBy("key", "salt")
    order = bucket.orderBy("wide", "uid", "place")
    begins = F.coalesce(F.lag("wide").over(order) != F.col("wide"), F.lit(True))
    marked = rows.repartition("key", "salt").withColumn("begins", begins & (F.col("salt") == 0))
    counted = marked.withColumn("classes", F.sum(F.col("begins").cast("long")).over(bucket.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return counted.where("not begins or classes > 1").select("uid", "key", "place", "first", "last", "classes", F.col("begins").alias("rep"))


FILTER_BITS = 26


def id_filter(rows: DataFrame) -> np.ndarray:
    """A bitmap of fixed size (8 MB) that holds the hash of every uid of ``rows``: a filter that lets all
    these through and, as long as they are not too many, few others. It saves moving other texts."""
    bit = F.pmod(F.xxhash64("uid"), F.lit(1 << FILTER_BITS))
    words = rows.select("uid").distinct().select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(uid), {1 << FILTER_BITS}) % 64 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def packed_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(uid, packed): compressed texts of the documents of ``wanted(uid)``, and of few others."""
    bits = docs.sparkSession.sparkContext.broadcast(id_filter(wanted))

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            hit = np.flatnonzero((bits.value[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1))
            for at in range(0, len(hit), TEXTS_AT_ONCE):
                some = batch.take(pa.array(hit[at : at + TEXTS_AT_ONCE]))
                yield pa.RecordBatch.from_arrays([some.column("uid"), pa.array([pack(_raw(t).tobytes()) for t in some.column("text").to_pylist()], pa.binary())], names=["uid", "packed"])

    slot = F.pmod(F.xxhash64("uid"), F.lit(1 << FILTER_BITS)).alias("slot")
    return docs.select("uid", "text", slot).mapInArrow(run, "uid long, packed binary")


def _with_texts(docs: DataFrame, ranges: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over the texts of the documents of ``ranges(uid, ...)`` beside the list of their ranges."""
    names = [c for c in ranges.columns if c != "uid"]
    listed = ranges.groupBy("uid").agg(F.collect_list(F.struct(*names)).alias("ranges"))
    texts = packed_texts(docs, ranges)
    return texts.join(listed, "uid").select("uid", "packed", "ranges").mapInArrow(run, schema)


def _unpack(packed: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)


def spelled(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """``reps(uid, key, place, first, last, hot)`` with ``span``, the bytes of all their windows."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found, spans = [], []
                for uid, packed, ranges in zip(part.column("uid").to_pylist(), part.column("packed").to_pylist(), part.column("ranges"), strict=True):
                    text = _unpack(packed).tobytes()
                    r = ranges.values
                    cols = {k: r.field(k).to_numpy(zero_copy_only=False) for k in ("key", "place", "first", "last", "hot")}
                    spans += [text[p - f : p - b + LENGTH] for p, f, b in zip(cols["place"].tolist(), cols["first"].tolist(), cols["last"].tolist(), strict=True)]
                    found.append({"uid": np.full(len(cols["key"]), uid, np.int64), **cols})
                if found:
                    head = _gathered(found)
                    yield pa.RecordBatch.from_arrays([*head.columns, pa.array(spans, pa.binary())], names=[*head.schema.names, "span"])

    return _with_texts(docs, reps, run, "uid long, key long, place long, first short, last short, hot boolean, span binary")


def _windows(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """All windows of spelled anchors: key, distance to the anchor, identifier, uid, start."""
    spans = batch.column("span").to_pylist()
    _, ids = identifiers(np.frombuffer(b"".join(spans), np.uint8))
    size = np.fromiter(map(len, spans), np.int64, len(spans))
    count = size - LENGTH + 1
    own = np.repeat(np.arange(len(spans)), count)
    step = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    far = batch.column("first").to_numpy().astype(np.int64)[own] - step
    col = lambda n: batch.column(n).to_numpy()[own]
    return {"key": col("key"), "far": far, "window": ids[(np.cumsum(size) - size)[own] + step].view(np.int64), "uid": col("uid"), "start": col("place") - far}


def _later(w: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Runs of windows that are not the first of their kind: uid, start, stop (of the last window's start)."""
    order = np.lexsort((w["start"], w["uid"], w["window"], w["far"], w["key"]))
    same = np.ones(len(order) - 1, bool)
    for k in ("key", "far", "window"):
        same &= w[k][order[1:]] == w[k][order[:-1]]
    hit = order[1:][same]
    hit = hit[np.lexsort((w["start"][hit], w["uid"][hit]))]
    uid, start = w["uid"][hit], w["start"][hit]
    begins = np.ones(len(hit), bool)
    begins[1:] = (uid[1:] != uid[:-1]) | (start[1:] > start[:-1] + 1)
    ends = np.append(begins[1:], True)[: len(hit)]
    return _batch({"uid": uid[begins], "start": start[begins], "stop": start[ends]})


def repeated_windows(spelled_reps: DataFrame) -> DataFrame:
    """(uid, start, stop): runs of windows that an earlier anchor of their bucket holds too."""

    def by_bucket(batches):
        carried = None
        for batch in batches:
            both = batch if carried is None else pa.Table.from_batches([carried, batch]).combine_chunks().to_batches()[0]
            keys = both.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last bucket may go on
            carried = both.slice(cut)
            if cut:
                yield _later(_windows(both.slice(0, cut)))
        if carried is not None and carried.num_rows:
            yield _later(_windows(carried))

    def all_windows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                yield _batch(_windows(batch.slice(at, 4096)))

    cold = spelled_reps.where("not hot").repartition("key").sortWithinPartitions("key").mapInArrow(by_bucket, "uid long, start long, stop long")
    kinds = Window.partitionBy("window", "key", "far").orderBy("uid", "start")
    hot = spelled_reps.where("hot").mapInArrow(all_windows, "key long, far long, window long, uid long, start long")
    hot = hot.withColumn("nth", F.row_number().over(kinds)).where("nth > 1").select("uid", "start", F.col("start").alias("stop"))
    return cold.unionByName(hot)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with uid: the doc_id, or where that is null or repeats a number in the order of (doc_id, text)."""
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if odd.isEmpty():
        return docs.withColumn("uid", F.col("doc_id"))
    return written(docs.repartitionByRange("doc_id", "text").sortWithinPartitions("doc_id", "text").withColumn("uid", F.monotonically_increasing_id()), "suffix_numbered")


def repeats(docs: DataFrame, hot_classes: int = 20_000) -> DataFrame:
    """(uid, start, stop): ranges of starts of windows of ``docs(uid, text)`` that occur earlier."""
    found = written(refined(anchor_rows(docs)), "suffix_anchors")
    whole = found.where("not rep").select("uid", (F.col("place") - F.col("first")).alias("start"), (F.col("place") - F.col("last")).alias("stop"))
    reps = found.where("rep").select("uid", "key", "place", "first", "last", (F.col("classes") > hot_classes).alias("hot"))
    return written(whole.unionByName(repeated_windows(written(spelled(docs, reps), "suffix_spans"))), "suffix_ranges")


def suffix_query(docs: DataFrame, hot_classes: int = 20_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    docs = numbered(columns_of(docs, "doc_id", "text"))

    def run(batches):
        for batch in batches:
            out = []
            for uid, packed, ranges in zip(batch.column("uid").to_pylist(), batch.column("packed").to_pylist(), batch.column("ranges"), strict=True):
                raw = _unpack(packed)
                edge = np.zeros(len(raw) + 1, np.int32)
                np.add.at(edge, ranges.values.field("start").to_numpy(), 1)
                np.add.at(edge, ranges.values.field("stop").to_numpy() + LENGTH, -1)
                gone = np.cumsum(edge[:-1]) > 0
                out.append((uid, int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(raw[~gone].tobytes()).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["u", "n_removed", "n_spans", "kept_sha256"])

    hit = _with_texts(docs, repeats(docs.select("uid", "text"), hot_classes), run, "u long, n_removed long, n_spans long, kept_sha256 string")
    raw = F.coalesce("text", F.lit("")).cast("binary")
    every = docs.select("doc_id", "uid", F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("sha"))
    out = every.join(hit, every["uid"] == hit["u"], "left")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
