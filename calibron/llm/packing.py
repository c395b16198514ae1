"""Best-fit packing of token sequences with a bounded number of open bins.

Every task tokenises the documents that it scans, cuts those longer than a sequence, and places the pieces
online: open bins stand in a bitset keyed by their free space, whose lowest bit at or above a piece's
length is the best fit; if none fits a new bin opens, and where all bins are open the fullest closes first.
What is left open at the end of a task (at most ``BINS`` bins) goes on to the next round: ``FAN`` tasks'
leftovers are placed anew, longest piece first, the fullest bins close until ``BINS`` are left, and so on until
one group remains, which closes all. So one task never holds more than ``FAN * BINS`` bins, whatever the input.

A piece is placed by what a task scans, in the order of the scan, hence a recomputed task gives the same rows.

Ids are those of the library. Neither the vocabulary nor its normaliser joins what stands on two sides of
ASCII white space, so words are looked up by a cache of whole words and only new ones are encoded.

Defined results: a null or empty text has the end id only, a sequence piece of length 1; texts of any length
are cut into whole sequences, only their last piece may be shorter; repeated rows and repeated or null doc_ids
are documents of their own; equal lengths are placed in the order of the scan; an empty table gives
an empty result; further columns, whatever their names, are ignored unless named in ``keep``.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from functools import lru_cache

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibron.llm.common import byte_level_table, columns_of, written

SIZE = 4096
#: Bins that a task keeps open.
BINS = 1024
#: Tasks whose leftovers meet in one of the next round.
FAN = 16
END = 1
#: Words, and bytes of words, of a generation of the cache.
CACHE_WORDS, CACHE_CHARS = 600_000, 48_000_000
#: A-Z, a-z and U+00C0 to U+012F without signs: NFC leaves them alone, each has one lower-case letter, and no pre-token ends between two.
LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf])+")
#: Runs of these after letters are pre-tokens; at most eight, so that there are few.
MARKS = b".,;:!?"


def default_tokenizer() -> str:
    """Where the public word-end vocabulary lies on every machine (a parameter of each function below)."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Ids of texts as little-endian unsigned 32-bit bytes, with a cache of words in two generations: where the
    young one is full it becomes the old one, from which words that come again are taken over."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.byte_level = self.tokenizer.model, byte_level_table()
        self.cache: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.marks: dict[bytes, bytes] = {}
        self.chars = 0

    def _of_letters(self, core: bytes) -> bytes:
        """Ids of letters: one pre-token that the normaliser only lowers, so its lower case goes straight to the merges."""
        low = core.decode().lower().encode()
        known = self.cache.get(low) or self.old.get(low)
        if known is None:
            known = array("I", [t.id for t in self.model.tokenize(low.decode("latin-1").translate(self.byte_level))]).tobytes()
            self.cache[low] = known
        return known

    def learn(self, words: list[bytes]) -> None:
        """Makes sure that the cache has the words, none of which is empty."""
        if len(self.cache) + len(words) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self.cache, self.old, self.chars = {}, self.cache, 0
        cache, old, new, letters = self.cache, self.old, [], LETTERS.fullmatch
        for w in words:
            if w in old:
                cache[w] = old[w]
            elif w not in cache:
                core = w.rstrip(MARKS)
                if not letters(core) or len(w) > len(core) + 8:
                    new.append(w)
                elif core == w:
                    cache[w] = self._of_letters(core)
                else:
                    marks = w[len(core) :]
                    if marks not in self.marks:
                        self.marks[marks] = array("I", self.tokenizer.encode(marks.decode(), add_special_tokens=False).ids).tobytes()
                    cache[w] = self._of_letters(core) + self.marks[marks]
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            made = self.tokenizer.encode_batch([w.decode() for w in part], add_special_tokens=False)
            cache.update((w, array("I", e.ids).tobytes()) for w, e in zip(part, made, strict=True))
        self.chars += sum(map(len, words))

    def encode(self, text: str | None) -> bytes:
        words = (text or "").encode().split()  # at space and \t\n\v\f\r only
        try:
            return b"".join(map(self.cache.__getitem__, words))
        except KeyError:
            wanted = dict.fromkeys(words)
            missing = [w for w in wanted if w not in self.cache]
            self.learn(missing if len(self.cache) + len(missing) <= CACHE_WORDS and self.chars <= CACHE_CHARS else list(wanted))
            return b"".join(map(self.cache.__getitem__, words))


@lru_cache(maxsize=2)
def tokenizer_of(path: str) -> WordTokenizer:
    """Made once in each Python worker."""
    return WordTokenizer(path)


class BestFit:
    """Open bins in a bitset keyed by free space. ``close`` gets the pieces of each bin that closes."""

    def __init__(self, size: int, bins: int, close):
        self.size, self.bins, self.close = size, bins, close
        self.free = 0  # bit f: a bin with f free places is open
        self.open = 0
        self.by_free: dict[int, list[list]] = {}

    def _take(self, free: int) -> list:
        stack = self.by_free[free]
        pieces = stack.pop()
        if not stack:
            self.free ^= 1 << free
        self.open -= 1
        return pieces

    def _keep(self, free: int, pieces: list) -> None:
        self.by_free.setdefault(free, []).append(pieces)
        self.free |= 1 << free
        self.open += 1

    @staticmethod
    def _lowest(bits: int) -> int:
        return (bits & -bits).bit_length() - 1

    def put(self, piece, length: int) -> None:
        fits = self.free >> length
        if fits:
            free = length + self._lowest(fits)
            pieces = self._take(free)
        else:
            self.shrink(self.bins - 1)
            free, pieces = self.size, []
        pieces.append(piece)
        if free > length:
            self._keep(free - length, pieces)
        else:
            self.close(pieces)

    def shrink(self, left: int) -> None:
        """Closes the fullest bins until no more than ``left`` are open."""
        while self.open > left:
            self.close(self._take(self._lowest(self.free)))

    def rest(self) -> list[list]:
        """The open bins, the fullest first."""
        return [pieces for free in sorted(self.by_free) for pieces in self.by_free[free]]


def _cut(ids: bytes, size: int):
    """(piece, start, length, bytes) of a document's ids."""
    for n, at in enumerate(range(0, len(ids), 4 * size)):
        part = ids[at : at + 4 * size]
        yield n, at // 4, len(part) // 4, part


PIECE = "piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, part long, turn long"


class _Rows:
    """Collects rows of pieces; a piece is a tuple (kept values, piece, start, length, crc, ids)."""

    def __init__(self, schema, with_ids: bool):
        self.schema, self.with_ids, self.rows, self.turn = schema, with_ids, [], 0

    def add(self, pieces: list, sequence: int | None, part: int) -> None:
        at = 0
        for keep, piece, start, length, crc, ids in pieces:
            self.rows.append((*keep, piece, start, length, crc, sequence, None if sequence is None else at, part, self.turn, *((ids,) if self.with_ids else ())))
            self.turn += 1
            at += length

    def batches(self, least: int):
        import pyarrow as pa

        while self.rows and len(self.rows) >= least:
            some, self.rows = self.rows[:10_000], self.rows[10_000:]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), self.schema, strict=True)], schema=self.schema)


def packed(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, bins: int = BINS, end: int = END, keep: tuple[str, ...] = ("doc_id",), text: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece: the ``keep`` columns of its document, piece, start, length, ids_crc32, sequence_id, offset.

    ``with_ids`` adds ``ids``, the piece's tokens as little-endian unsigned 32-bit bytes.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    if size < 1 or bins < 1:
        raise ValueError("size and bins must be 1 or more")
    path = tokenizer or default_tokenizer()
    source = columns_of(docs, *keep, *([] if text in keep else [text]))
    kept = [T.StructField(f"k{n}", source.schema[k].dataType) for n, k in enumerate(keep)]
    out = T.StructType(kept + list(T._parse_datatype_string(PIECE + (", ids binary" if with_ids else "")).fields))
    arrow = to_arrow_schema(out)
    last = array("I", [end]).tobytes()

    def place(batches):
        tokens, part = tokenizer_of(path), TaskContext.get().partitionId()
        rows, serial = _Rows(arrow, with_ids), [part << 32]

        def close(pieces):
            rows.add(pieces, serial[0], part)
            serial[0] += 1

        fit = BestFit(size, bins, close)
        for b in batches:
            values = zip(*(b.column(k).to_pylist() for k in keep), strict=True) if keep else ((),) * b.num_rows
            for held, t in zip(values, b.column(text), strict=True):
                for piece, start, length, ids in _cut(tokens.encode(t.as_py()) + last, size):
                    fit.put((held, piece, start, length, zlib.crc32(ids), ids if with_ids else None), length)
                yield from rows.batches(10_000)
        for pieces in fit.rest():
            rows.add(pieces, None, part)
        yield from rows.batches(1)

    def again(left: int, level: int):
        def merge(table: pa.Table) -> pa.Table:
            up = table.column("up")[0].as_py()
            rows, serial = _Rows(arrow, with_ids), [(level << 58) | (up << 32)]

            def close(pieces):
                rows.add(pieces, serial[0], up)
                serial[0] += 1

            names = [f.name for f in kept] + ["piece", "start", "length", "ids_crc32"]
            table = table.sort_by([("length", "descending"), ("part", "ascending"), ("turn", "ascending")])
            cols = [table.column(c).to_pylist() for c in names] + [table.column("ids").to_pylist() if with_ids else [None] * table.num_rows]
            fit = BestFit(size, table.num_rows + 1, close)
            n = len(kept)
            for row in zip(*cols, strict=True):
                fit.put((row[:n], *row[n:]), row[n + 2])
            fit.shrink(left)
            for pieces in fit.rest():
                rows.add(pieces, None, up)
            return pa.Table.from_batches(list(rows.batches(1)), schema=arrow)

        return merge

    placed = written(source.mapInArrow(place, out), "packing")
    closed, level = placed.where("sequence_id is not null"), 0
    rest = placed.where("sequence_id is null")
    while True:
        parts = rest.agg(F.max("part")).first()[0]
        if parts is None:
            break
        level += 1
        up = rest.withColumn("up", F.floor(F.col("part") / FAN))
        merged = written(up.groupBy("up").applyInArrow(again(0 if parts < FAN else bins, level), out), "packing")
        closed = closed.unionByName(merged.where("sequence_id is not null"))
        if parts < FAN:
            break
        rest = merged.where("sequence_id is null")
    return closed.select(*(F.col(f.name).alias(k) for f, k in zip(kept, keep, strict=True)), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))


def sequences(docs: DataFrame, **options) -> DataFrame:
    """(sequence_id, n_tokens, ids): the packed sequences; a group is one sequence of bounded length."""
    pieces = packed(docs, with_ids=True, **options).select("sequence_id", "offset", "length", "ids")
    whole = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return whole.select("sequence_id", "n_tokens", F.aggregate("p", F.lit(b""), lambda s, x: F.concat(s, x["ids"])).alias("ids"))


def packing_query(docs: DataFrame) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packed(docs)
