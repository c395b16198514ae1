"""Alignment of the tokens that two tokenizers make of the same text.

A is a byte-level BPE and reads space + text, B a SentencePiece model and reads text, before which it puts a
space itself. Both sequences cover the same bytes. The byte offsets at which tokens end are bits of two packed
bitsets; their AND has the shared cuts, rank by popcount maps each cut to the number of A and of B tokens
up to it, and so cuts the two sequences into groups; every A token of a group is linked with every B token.

Neither tokenizer joins a non-space with a space after it, so a text is cut into units there, each a
space and what follows; a unit's tokens, groups and links don't depend on its text. Units are aligned
once, many side by side, and looked up by a cache in each worker.

The corpus-wide counts of id pairs come from two exchanges of packed columns. A block of documents (``BLOCK_CHARS``)
asks for its distinct pairs, dealt out over buckets by hash; a bucket adds up how many documents hold each pair,
answers every block, and gives the highest count of each A id, of which there are no more than the vocabulary has
ids. Blocks then add up what their documents' units are worth. No text and no link moves alone.

Defined results: null and empty texts, and texts that A or B doesn't give back byte by byte (a text with
U+2581, the sign that B has for a space), have no tokens; strings of special tokens are plain text; texts of any
length are taken whole, a text longer than a block is a block of its own; repeated rows and repeated or null
doc_ids are documents of their own; of equal counts all are best; an empty table gives an empty result;
further columns, whatever their names, are ignored unless named in ``keep``.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibron.llm.common import byte_level_table, columns_of, written

#: Characters of the documents of a block.
BLOCK_CHARS = 4_000_000
#: Units, and characters of units, that a worker remembers before it starts anew.
CACHE_UNITS, CACHE_CHARS = 400_000, 24_000_000
#: Units that are aligned side by side.
SIDE = 8192
#: Unicode white space, as both pre-tokenizers know it.
BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A space after white space, where a unit doesn't end.
AWKWARD = re.compile(f"[{BLANK}] ")
BORDER = re.compile(f"(?<=[^{BLANK}]) ")
#: Letters of A-Z, a-z and U+00C0 to U+012F, then at most eight marks.
PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]+)([.,;:!?]{0,8})")
#: Links of a group beyond which equal ids are brought together before they expand.
WIDE = 1 << 16


def default_tokenizers() -> tuple[str, str]:
    """Where the public files of A and B lie on every machine (a parameter of each function below)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def units_of(text: str) -> list[str]:
    """The units of space + text, each without its leading space."""
    if AWKWARD.search(text) or text[:1] == " ":
        return [u[1:] for u in _cut(" " + text)]
    return text.split(" ")


def _cut(text: str) -> list[str]:
    at = [0, *(m.start() for m in BORDER.finditer(text)), len(text)]
    return [text[x:y] for x, y in zip(at, at[1:], strict=False)]


def packed_bits(positions: np.ndarray, size: int) -> np.ndarray:
    """A bitset of ``size`` bits in 64-bit words with the bits at ``positions``."""
    flags = np.zeros(-(-size // 64) * 64, bool)
    flags[positions] = True
    return np.packbits(flags, bitorder="little").view(np.uint64)


def selected(bits: np.ndarray) -> np.ndarray:
    """The positions of the bits that are set."""
    return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))


def rank(bits: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """How many bits are set up to and at each position: whole words by running popcounts, then a masked word."""
    before = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.bitwise_count(bits), dtype=np.int64)))
    word = positions >> 6
    mask = (np.uint64(2) << (positions & 63).astype(np.uint64)) - np.uint64(1)
    return before[word] + np.bitwise_count(bits[word] & mask)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - starts, sizes)


class Units:
    """What a worker knows of units: an index by unit, and by index counts, groups as text, and pairs in CSR form."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.model, self.byte_level = self.a.model, byte_level_table()
        self.marks: dict[str, list[int]] = {"": []}
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.raw_a = self._byte_level([self.a.id_to_token(k) or "" for k in range(self.a.get_vocab_size())])
        n = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(k) for k in range(n)]
        self.raw_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else b"" if self.b.is_control(k) else p.replace("\u2581", " ").encode() for k, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.array(list(map(len, raw)), np.int64) for raw in (self.raw_a, self.raw_b))
        self.shift = np.uint32(max(1, (n - 1).bit_length()))
        if (len(self.raw_a) << int(self.shift)) > 1 << 32:
            raise ValueError("the ids of both vocabularies don't fit in 32 bits")
        self.names = [str(k) for k in range(max(n, len(self.raw_a)))]
        self.space = self.b.piece_to_id("\u2581")
        self.clear()

    @staticmethod
    def _byte_level(tokens: list[str]) -> list[bytes]:
        """The bytes that the characters of byte-level entries stand for."""
        of = {c: b for b, c in byte_level_table().items()}
        return [bytes(of[c] for c in t) if all(c in of for c in t) else t.encode() for t in tokens]

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.chars = 0
        self.groups: list[str | None] = []  # None: bytes aren't given back
        self.stats = np.zeros((0, 4), np.int64)  # A tokens, B tokens, groups, links
        self.starts = np.zeros(1, np.int64)
        self.pairs = np.zeros(0, np.uint32)
        self.times = np.zeros(0, np.int64)

    def full(self) -> bool:
        return len(self.index) > CACHE_UNITS or self.chars > CACHE_CHARS

    def tokens(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and of B of each unit. Letters after a space are one pre-token of A, marks after them another."""
        a: list[list[int] | None] = [None] * len(units)
        for k, u in enumerate(units):
            if found := PLAIN.fullmatch(u):
                core, marks = found.groups()
                if marks not in self.marks:
                    self.marks[marks] = self.a.encode(marks, add_special_tokens=False).ids
                a[k] = [t.id for t in self.model.tokenize((" " + core).encode().decode("latin-1").translate(self.byte_level))] + self.marks[marks]
        rest = [k for k, ids in enumerate(a) if ids is None]
        for k, e in zip(rest, self.a.encode_batch([" " + units[k] for k in rest], add_special_tokens=False), strict=True):
            a[k] = e.ids
        b = self.b.encode(units, num_threads=1)
        return a, [ids if u else [self.space] for u, ids in zip(units, b, strict=True)]

    def learn(self, units: list[str]) -> None:
        """Aligns new units, ``SIDE`` at a time."""
        found: list[tuple] = []
        for at in range(0, len(units), SIDE):
            found.append(self._align(units[at : at + SIDE]))
        for u in units:
            self.index[u] = len(self.index)
        self.chars += sum(map(len, units))
        self.groups += [g for f in found for g in f[0]]
        self.stats = np.concatenate((self.stats, *(f[1] for f in found)))
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(np.concatenate([f[2] for f in found]))))
        self.pairs = np.concatenate((self.pairs, *(f[3] for f in found)))
        self.times = np.concatenate((self.times, *(f[4] for f in found)))

    def cuts(self, units: list[str]) -> tuple:
        """The ids of both sequences over the units that both give back, those units, and for each group its unit and its first and end A and B token."""
        a, b = self.tokens(units)
        whole = [b"".join(map(self.raw_a.__getitem__, x)) == (t := (" " + u).encode()) == b"".join(map(self.raw_b.__getitem__, y)) for u, x, y in zip(units, a, b, strict=True)]
        good = [k for k, w in enumerate(whole) if w]
        ids_a = np.fromiter((i for k in good for i in a[k]), np.int64)
        ids_b = np.fromiter((i for k in good for i in b[k]), np.int64)
        ends_a, ends_b = np.cumsum(self.len_a[ids_a]), np.cumsum(self.len_b[ids_b])
        if not len(ids_a):
            none = np.zeros(0, np.int64)
            return ids_a, ids_b, good, none, none, none, none, none
        size = int(ends_a[-1])
        bits_a, bits_b = packed_bits(ends_a - 1, size), packed_bits(ends_b - 1, size)
        shared = selected(bits_a & bits_b)
        to_a, to_b = rank(bits_a, shared), rank(bits_b, shared)
        from_a, from_b = np.concatenate(([0], to_a[:-1])), np.concatenate(([0], to_b[:-1]))
        unit = np.repeat(np.arange(len(good)), [len(a[k]) for k in good])[to_a - 1]
        return ids_a, ids_b, good, unit, from_a, to_a, from_b, to_b

    def _align(self, units: list[str]) -> tuple:
        ids_a, ids_b, good, unit, from_a, to_a, from_b, to_b = self.cuts(units)
        n = len(units)
        groups: list[str | None] = [None] * n
        stats, sizes = np.zeros((n, 4), np.int64), np.zeros(n, np.int64)
        if not len(unit):
            return groups, stats, sizes, np.zeros(0, np.uint32), np.zeros(0, np.int64)
        names_a, names_b = list(map(self.names.__getitem__, ids_a.tolist())), list(map(self.names.__getitem__, ids_b.tolist()))
        parts: list[list[str]] = [[] for _ in good]
        for u, i, j, k, m in zip(unit.tolist(), from_a.tolist(), to_a.tolist(), from_b.tolist(), to_b.tolist(), strict=True):
            parts[u].append(f"{','.join(names_a[i:j])}|{','.join(names_b[k:m])}")
        for u, p in zip(good, parts, strict=True):
            groups[u] = ";".join(p)
        n_a, n_b = to_a - from_a, to_b - from_b
        at = np.array(good)[unit]
        for column, value in enumerate((n_a, n_b, np.ones(len(unit), np.int64), n_a * n_b)):
            np.add.at(stats[:, column], at, value)
        key, times = self._links(ids_a, ids_b, at, from_a, n_a, from_b, n_b)
        sizes += np.bincount((key >> np.uint64(32)).astype(np.int64), minlength=n)
        return groups, stats, sizes, (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), times

    def _links(self, ids_a, ids_b, unit, from_a, n_a, from_b, n_b) -> tuple[np.ndarray, np.ndarray]:
        """(unit << 32 | pair, times) of all links, sorted and distinct."""
        narrow = n_a * n_b <= WIDE
        g_unit, g_a, g_na, g_b, g_nb = (v[narrow] for v in (unit, from_a, n_a, from_b, n_b))
        tokens = _ranges(g_a, g_na)
        each = np.repeat(g_nb, g_na)
        pair = (np.repeat(ids_a[tokens], each) << int(self.shift)) | ids_b[_ranges(np.repeat(g_b, g_na), each)]
        keys = [(np.repeat(np.repeat(g_unit, g_na), each) << 32) | pair]
        times = [np.ones(len(pair), np.int64)]
        for g in np.flatnonzero(~narrow).tolist():
            a, of_a = np.unique(ids_a[from_a[g] : from_a[g] + n_a[g]], return_counts=True)
            b, of_b = np.unique(ids_b[from_b[g] : from_b[g] + n_b[g]], return_counts=True)
            keys.append((int(unit[g]) << 32) | ((a << int(self.shift))[:, None] | b).ravel())
            times.append(np.outer(of_a, of_b).ravel())
        return summed(np.concatenate(keys).astype(np.uint64), np.concatenate(times))

    def look_up(self, texts: list[str | None]) -> list[np.ndarray]:
        """The indices of each text's units; no unit for a null or an empty text."""
        cut = [units_of(t) if t else [] for t in texts]
        new = list(dict.fromkeys(u for units in cut for u in units if u not in self.index))
        if new:
            self.learn(new)
        get = self.index.__getitem__
        return [np.fromiter(map(get, units), np.int64, len(units)) for units in cut]


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sum of their values."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(values, first) if len(first) else values[:0]


@lru_cache(maxsize=1)
def units_from(path_a: str, path_b: str) -> Units:
    """Made once in each Python worker."""
    return Units(path_a, path_b)


def _dense(values: np.ndarray) -> bytes:
    import pyarrow as pa

    return pa.compress(np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def _numbers(data: bytes, n: int) -> np.ndarray:
    import pyarrow as pa

    return np.ascontiguousarray(np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n).T).view("<u4").ravel() if n else np.zeros(0, "<u4")


def _packed(values: np.ndarray) -> dict:
    return {"n": len(values), "data": _dense(values)}


def _unpacked(cell: dict) -> np.ndarray:
    return _numbers(cell["data"], cell["n"])


def bucket_of(pairs: np.ndarray, buckets: int) -> np.ndarray:
    return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(buckets)


NUMBERS = "struct<n:long,data:binary>"


class Block:
    """Documents whose texts are looked up together."""

    def __init__(self, units: Units):
        self.units, self.docs, self.kept, self.hashes, self.stats, self.chars = units, [], [], [], [], 0

    def add(self, kept: list[tuple], texts: list[str | None]) -> None:
        u = self.units
        for seen in u.look_up(texts):
            parts = list(map(u.groups.__getitem__, seen.tolist()))
            if not parts or None in parts:
                seen, parts = seen[:0], []
            self.docs.append(seen)
            self.hashes.append(hashlib.sha256(";".join(parts).encode()).hexdigest() if parts else "")
            self.stats.append(u.stats[seen].sum(axis=0).tolist())
        self.kept += kept
        self.chars += sum(len(t) for t in texts if t)

    def rows(self, block: int, buckets: int) -> tuple[dict, list[dict]]:
        """The block's own row, and what it asks each bucket: its distinct pairs and how many of its documents hold each."""
        u = self.units
        lengths = np.array(list(map(len, self.docs)), np.int64)
        every = np.concatenate(self.docs) if self.docs else np.zeros(0, np.int64)
        used, own = np.unique(every, return_inverse=True)
        sizes = u.starts[used + 1] - u.starts[used]
        cells = _ranges(u.starts[used], sizes)
        pairs = u.pairs[cells]
        doc = np.repeat(np.arange(len(self.docs)), lengths)
        # each document's distinct units, then its distinct pairs
        held = np.unique((doc.astype(np.uint64) << np.uint64(32)) | own.astype(np.uint64))
        which, unit = (held >> np.uint64(32)).astype(np.int64), (held & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.cumsum(sizes) - sizes
        at = _ranges(first[unit], sizes[unit])
        in_doc = np.unique((np.repeat(which, sizes[unit]).astype(np.uint64) << np.uint64(32)) | pairs[at])
        known, n_docs = np.unique((in_doc & np.uint64(0xFFFFFFFF)).astype(np.uint32), return_counts=True)
        bucket = bucket_of(known, buckets)
        order = np.lexsort((known, bucket))
        known, n_docs, bucket = known[order], n_docs[order], bucket[order]
        place = np.empty(len(known), np.int64)
        place[np.argsort(known, kind="stable")] = np.arange(len(known))  # sorted place of each asked pair
        asked_at = np.empty(len(known), np.int64)
        asked_at[place] = np.arange(len(known))
        slot = asked_at[np.searchsorted(np.sort(known), pairs)]
        stats = np.array(self.stats, np.int64).reshape(-1, 4)
        own_row = {"block": block, "docs": self.kept, "stats": stats, "hashes": self.hashes, "units": _packed(own), "lengths": _packed(lengths), "sizes": _packed(sizes), "slots": _packed(slot), "times": _packed(u.times[cells]), "pairs": _packed(known)}
        edges = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
        asks = [{"block": block, "bucket": b, "pairs": _packed(known[x:y]), "counts": _packed(n_docs[x:y])} for b, (x, y) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if y > x]
        return own_row, asks


def _buckets(docs: DataFrame) -> int:
    return max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def blocks(docs: DataFrame, keep: tuple[str, ...], text: str, paths: tuple[str, str], buckets: int) -> DataFrame:
    """Rows of kind ``block`` and of kind ``ask``, see :class:`Block`; written once."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    source = columns_of(docs, *keep, *([] if text in keep else [text]))
    kept = T.StructType([T.StructField(f"k{n}", source.schema[k].dataType) for n, k in enumerate(keep)])
    doc = T.StructType([*kept, *T._parse_datatype_string("n_a long, n_b long, n_groups long, n_links long, groups_sha256 string").fields])
    rest = T._parse_datatype_string(f"kind string, block long, bucket int, pairs {NUMBERS}, counts {NUMBERS}, units {NUMBERS}, lengths {NUMBERS}, sizes {NUMBERS}, slots {NUMBERS}, times {NUMBERS}")
    out = T.StructType([*rest, T.StructField("docs", T.ArrayType(doc))])
    arrow = to_arrow_schema(out)
    names = [f.name for f in doc]

    def table(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=arrow)

    def made(block: Block, serial: int):
        row, asks = block.rows(serial, buckets)
        stats, hashes = row.pop("stats").tolist(), row.pop("hashes")
        row["docs"] = [dict(zip(names, (*k, *s, h), strict=True)) for k, s, h in zip(row["docs"], stats, hashes, strict=True)]
        yield table([{"kind": "block", **row}])
        yield table([{"kind": "ask", **a} for a in asks])

    def run(batches):
        units, serial = units_from(*paths), TaskContext.get().partitionId() << 32
        block = Block(units)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                held = list(zip(*(part.column(k).to_pylist() for k in keep), strict=True)) if keep else [()] * part.num_rows
                block.add(held, part.column(text).to_pylist())
                if block.chars >= BLOCK_CHARS or units.full():
                    yield from made(block, serial)
                    serial += 1
                    if units.full():
                        units.clear()
                    block = Block(units)
        if block.docs:
            yield from made(block, serial)

    return written(source.mapInArrow(run, out), "alignment", partition_by=["kind"])


def bucket_sums(asks: DataFrame, shift: int) -> DataFrame:
    """Rows of kind ``answer`` (block, bucket, counts) and of kind ``sum`` (the bucket's pairs, their counts, and each A id's highest); written once."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = f"kind string, block long, bucket int, pairs {NUMBERS}, counts {NUMBERS}, ids {NUMBERS}, highest {NUMBERS}"
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(group: pa.Table) -> pa.Table:
        asked = [_unpacked(c) for c in group.column("pairs").to_pylist()]
        counts = np.concatenate([_unpacked(c) for c in group.column("counts").to_pylist()]).astype(np.int64)
        pairs, total = summed(np.concatenate(asked), counts)
        ids = pairs >> np.uint32(shift)
        first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        bucket = group.column("bucket")[0].as_py()
        rows = [{"kind": "sum", "bucket": bucket, "pairs": _packed(pairs), "counts": _packed(total), "ids": _packed(ids[first]), "highest": _packed(np.maximum.reduceat(total, first))}]
        rows += [{"kind": "answer", "block": b, "bucket": bucket, "counts": _packed(total[np.searchsorted(pairs, a)])} for b, a in zip(group.column("block").to_pylist(), asked, strict=True)]
        return pa.Table.from_pylist(rows, schema=arrow)

    return written(asks.groupBy("bucket").applyInArrow(run, schema), "alignment_sums", partition_by=["kind"])


def highest_counts(sums: DataFrame, size: int) -> np.ndarray:
    """For each A id its highest count: at most one number for each id of the vocabulary arrives at the driver."""
    import pyarrow as pa

    def split(batches):
        for b in batches:
            ids = np.concatenate([_unpacked(c) for c in b.column("ids").to_pylist()] or [np.zeros(0, "<u4")])
            top = np.concatenate([_unpacked(c) for c in b.column("highest").to_pylist()] or [np.zeros(0, "<u4")])
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(top.astype(np.int64))], names=["id", "top"])

    best = np.zeros(size, np.int64)
    for r in sums.select("ids", "highest").mapInArrow(split, "id long, top long").groupBy("id").agg(F.max("top").alias("top")).collect():
        best[r["id"]] = r["top"]
    return best


def _exchanged(docs: DataFrame, keep: tuple[str, ...], text: str, tokenizers: tuple[str, str] | None):
    paths = tokenizers or default_tokenizers()
    units = units_from(*paths)
    kinds = blocks(docs, keep, text, paths, _buckets(docs))
    return kinds, bucket_sums(kinds.where("kind = 'ask'").select("block", "bucket", "pairs", "counts"), int(units.shift)), units


def aligned(docs: DataFrame, tokenizers: tuple[str, str] | None = None, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The ``keep`` columns and n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds, sums, units = _exchanged(docs, keep, text, tokenizers)
    best, shift = highest_counts(sums.where("kind = 'sum'"), len(units.raw_a)), int(units.shift)
    own = kinds.where("kind = 'block'").select("block", "docs", "pairs", "units", "lengths", "sizes", "slots", "times")
    answers = sums.where("kind = 'answer'").select("block", "bucket", "counts")
    doc = own.schema["docs"].dataType.elementType
    out = T.StructType([*doc, *T._parse_datatype_string("n_best long, count_sum long").fields])
    arrow = to_arrow_schema(out)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        made = []
        if left.num_rows:
            row = left.to_pylist()[0]
            right = right.sort_by("bucket")
            pairs, unit, lengths, sizes, slots, times = (_unpacked(row[c]).astype(np.int64) for c in ("pairs", "units", "lengths", "sizes", "slots", "times"))
            n = np.concatenate([_unpacked(c) for c in right.column("counts").to_pylist()] or [np.zeros(0, "<u4")]).astype(np.int64)
            top = best[pairs >> shift] == n
            of_unit = np.repeat(np.arange(len(sizes)), sizes)
            worth, bests = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            np.add.at(worth, of_unit, n[slots] * times)
            np.add.at(bests, of_unit, top[slots] * times)
            ends = np.concatenate(([0], np.cumsum(lengths)))
            run_worth, run_best = (np.concatenate(([0], np.cumsum(v[unit]))) for v in (worth, bests))
            for d, b, c in zip(row["docs"], (run_best[ends[1:]] - run_best[ends[:-1]]).tolist(), (run_worth[ends[1:]] - run_worth[ends[:-1]]).tolist(), strict=True):
                made.append(d | {"n_best": b, "count_sum": c})
        return pa.Table.from_pylist(made, schema=arrow)

    rows = own.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, out)
    return rows.select(*(F.col(f"k{n}").alias(k) for n, k in enumerate(keep)), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def link_table(docs: DataFrame, tokenizers: tuple[str, str] | None = None, text: str = "text") -> DataFrame:
    """(a, b, n_docs, best): how many documents hold the id pair linked, and whether no pair of its A id has more."""
    import pyarrow as pa

    _, sums, units = _exchanged(docs, (), text, tokenizers)
    sums = sums.where("kind = 'sum'")
    best, shift = highest_counts(sums, len(units.raw_a)), int(units.shift)

    def split(batches):
        for batch in batches:
            for p, c in zip(batch.column("pairs").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                pairs, n = _unpacked(p).astype(np.int64), _unpacked(c).astype(np.int64)
                a = pairs >> shift
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(pairs & ((1 << shift) - 1)), pa.array(n), pa.array(best[a] == n)], names=["a", "b", "n_docs", "best"])

    return sums.select("pairs", "counts").mapInArrow(split, "a long, b long, n_docs long, best boolean")


def token_groups(docs: DataFrame, tokenizers: tuple[str, str] | None = None, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The ``keep`` columns and ``groups``: byte range in space + text, A ids and B ids of each group, in order; none where a text isn't given back."""
    from calibron.llm.common import map_texts

    paths = tokenizers or default_tokenizers()

    def run(texts: list[str | None]) -> list:
        u, out = units_from(*paths), []
        for t in texts:
            found = []
            if t:
                units = units_of(t)
                ids_a, ids_b, good, _, from_a, to_a, from_b, to_b = u.cuts(units)
                if len(good) == len(units):
                    ends = np.cumsum(u.len_a[ids_a])
                    a, b, start = ids_a.tolist(), ids_b.tolist(), 0
                    for i, j, k, m in zip(from_a.tolist(), to_a.tolist(), from_b.tolist(), to_b.tolist(), strict=True):
                        found.append({"start": start, "end": int(ends[j - 1]), "a": a[i:j], "b": b[k:m]})
                        start = int(ends[j - 1])
            out.append(found)
        return [out]

    return map_texts(docs, run, "groups array<struct<start:long,end:long,a:array<int>,b:array<int>>>", keep=keep, text=text)


def alignment_query(docs: DataFrame) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    return aligned(docs)
