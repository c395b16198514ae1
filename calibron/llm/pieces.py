"""SentencePiece encoding and decoding by batched numpy Viterbi.

The lattice of a word holds every piece that matches a substring. Words of equal length advance
together, one end position at a time: polynomial substring hashes probe the sorted piece keys, every
piece that ends there and may follow the best path to its start is a candidate, a vectorised maximum
picks one, and its length is the backpointer.

Two kinds of models, as their file says:

* unigram: the score of a path is the sum of its pieces' scores, the maximum is the best path;
* BPE: a path is admissible if every two neighbouring pieces stay two pieces when merged greedily
  alone (score first, then leftmost). Such a path exists once for each prefix and is the result of the
  greedy merges, so the same forward pass with admissible/not admissible as the score gives exactly the
  library's ids (merges never cross a final border, hence borders depend on their two neighbours only).

Characters that no piece holds become byte pieces. Words are cut where no piece holds the two
neighbouring characters, which no path and no merge can cross.

Defined results: null and empty texts have no ids; decoding gives the text back, except that U+2581,
the model's own sign for a space, comes back as a space; repeated rows give repeated results. Texts of any length
are encoded whole; a word of over ``LONG`` characters that can't be cut advances alone, in time in
proportion to its length. Of equal paths of a unigram model the one whose last piece is longest is taken, a
BPE model has no equal ones. An empty table gives an empty result; further columns, whatever their names, are
ignored unless named in ``keep``.
"""

from __future__ import annotations

import hashlib
import re
import struct
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from calibron.llm.common import map_texts

SPACE_SIGN = "\u2581"
UNIT = re.compile(f"{SPACE_SIGN}*[^{SPACE_SIGN}]+|{SPACE_SIGN}+")
BASE = np.uint64(0x5851F42D4C957F2D)
NONE = np.int64(-1)
#: Words that a worker remembers before it starts anew.
CACHE_WORDS = 600_000
LATE = np.int64(1 << 40)
#: Words longer than this advance alone, without arrays; and neighbours of pieces that are remembered for them.
LONG, CACHE_PAIRS = 256, 1_000_000


def default_model() -> str:
    """Where the public 32k model lies on every machine (a parameter of each function below)."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)


def _hashes(codes: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes, modulo 2**64."""
    h = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
    for k in range(codes.shape[1]):
        h[:, k + 1] = h[:, k] * BASE + (codes[:, k].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return h


class PieceModel:
    """The tables of one model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self._setup([(p.piece, p.score, p.type) for p in proto.pieces], proto.trainer_spec.model_type == 2, proto.normalizer_spec.add_dummy_prefix)

    @classmethod
    def of(cls, pieces: list[tuple[str, float, int]], bpe: bool, prefix: bool = True) -> PieceModel:
        """From (piece, score, type) rows, type 1 for a normal piece, 2 unknown, 3 control, 6 byte."""
        self = cls.__new__(cls)
        self._setup(pieces, bpe, prefix)
        return self

    def _setup(self, pieces: list[tuple[str, float, int]], bpe: bool, prefix: bool) -> None:
        self.bpe, self.prefix, self.size = bpe, prefix, len(pieces)
        normal = {p: k for k, (p, _, kind) in enumerate(pieces) if kind == 1}
        self.bytes = {int(p[3:5], 16): k for k, (p, _, kind) in enumerate(pieces) if kind == 6}
        self.unknown = next((k for k, p in enumerate(pieces) if p[2] == 2), 0)
        self.raw = [bytes([int(p[3:5], 16)]) if kind == 6 else b"" if kind in (2, 3) else p.encode() for p, _, kind in pieces]
        self.chars = {c for p in normal for c in p}
        names = list(normal) + sorted(self.chars - set(normal))  # a character may be a part of pieces but none itself
        ids = [normal.get(n, self.size + k) for k, n in enumerate(names)]
        self.symbol = dict(zip(names, ids, strict=True))
        self.width = max(map(len, names), default=1)
        score = np.full(self.size + len(names), -np.inf)
        for p, k in normal.items():
            score[k] = pieces[k][1]
        self.score = score
        keys = np.array([_hashes(_codes([n]))[0, -1] for n in names], np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array(ids, np.int64)[order]
        self.maybe = np.zeros(1 << 20, bool)  # a first look that turns most other substrings away
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.powers = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(self.width, BASE, np.uint64))))
        together = np.array(sorted({(ord(a) << 21) | ord(b) for n in names for a, b in zip(n, n[1:], strict=False)}), np.int64)
        self.together = together if len(together) else np.array([-1], np.int64)
        self.cache: dict[str, tuple[int, ...]] = {}
        self.parts: dict[str, tuple[int, ...]] = {}
        if bpe:
            self._merge_tables(normal)

    def _merge_tables(self, normal: dict[str, int]) -> None:
        """Ranks, the pairs that merge, and each piece's outer parts by the time at which they are formed."""
        ranked = sorted(normal.items(), key=lambda x: -self.score[x[1]])
        rank = np.full(len(self.score), -1, np.int64)
        for r, (p, k) in enumerate(ranked):
            rank[k] = r if len(p) > 1 else -1
        self.rank = rank
        pairs = {}
        for p, k in normal.items():
            for cut in range(1, len(p)):
                a, b = self.symbol.get(p[:cut]), self.symbol.get(p[cut:])
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = rank[k]
        self.pairs, self.neighbours = pairs, {}
        self.pair_keys = np.array(sorted(pairs) or [-1], np.int64)
        self.pair_rank = np.array([pairs[k] for k in sorted(pairs)] or [0], np.int64)
        self.maybe_pair = np.zeros(1 << 20, bool)
        self.maybe_pair[self._pair_slot(self.pair_keys)] = True
        n = len(self.score)
        self.left, self.right, self.whole = np.full(n, NONE), np.full(n, NONE), np.zeros(n, bool)
        name = {v: k for k, v in self.symbol.items()}
        for k in sorted(name, key=lambda k: len(name[k])):
            parts, ok = [self.symbol[c] for c in name[k]], True
            while len(parts) > 1:
                at, best = -1, LATE
                for j in range(len(parts) - 1):
                    r = pairs.get((parts[j] << 32) | parts[j + 1], LATE)
                    if r < best:
                        at, best = j, r
                if at < 0:
                    ok = False
                    break
                made = self.symbol[name[parts[at]] + name[parts[at + 1]]]
                if len(parts) == 2:
                    self.left[k], self.right[k] = parts
                    if max(rank[parts[0]], rank[parts[1]]) >= rank[k]:
                        raise ValueError(f"piece {name[k]!r} ranks before one of its parts; such a model isn't supported")
                parts[at : at + 2] = [made]
            self.whole[k] = ok and parts == [k]

    @staticmethod
    def _pair_slot(key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * BASE) >> np.uint64(44)

    def _stay_apart(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Whether greedy merging of each u + v ends in [u, v]: goes back through the times at which the
        last part of u and the first part of v stood side by side, and asks if they would have merged."""
        apart = np.ones(len(u), bool)
        live = np.flatnonzero((u >= 0) & (v >= 0))
        x, y = u[live], v[live]
        used_x, used_y = np.full(len(live), LATE), np.full(len(live), LATE)
        while len(live):
            key = (x << 32) | y
            rank_x, rank_y, right, left = self.rank[x], self.rank[y], self.right[x], self.left[y]
            go = (right >= 0) | (left >= 0)
            seen = np.flatnonzero(self.maybe_pair[self._pair_slot(key)])
            if len(seen):
                at = np.minimum(np.searchsorted(self.pair_keys, key[seen]), len(self.pair_keys) - 1)
                when = np.maximum(np.where(self.pair_keys[at] == key[seen], self.pair_rank[at], LATE), np.maximum(rank_x, rank_y)[seen])
                merged = seen[(when < used_x[seen]) & (when <= used_y[seen]) & (when < LATE)]
                apart[live[merged]] = False
                go[merged] = False
            down_x = (rank_x >= rank_y) & (right >= 0)
            used_x, used_y = np.where(down_x, rank_x, used_x), np.where(down_x, used_y, rank_y)
            x, y = np.where(down_x, right, x), np.where(down_x, y, left)
            if not go.all():
                live, x, y, used_x, used_y = live[go], x[go], y[go], used_x[go], used_y[go]
        return apart

    def _apart(self, u: int, v: int) -> bool:
        """:meth:`_stay_apart` of two pieces, remembered: a long word has the same neighbours again and again."""
        key = (u << 32) | v
        known = self.neighbours.get(key)
        if known is None:
            x, y, used_x, used_y, known = u, v, int(LATE), int(LATE), True
            while True:
                rank_x, rank_y, right, left = int(self.rank[x]), int(self.rank[y]), int(self.right[x]), int(self.left[y])
                merge = self.pairs.get((x << 32) | y)
                if merge is not None and (when := max(int(merge), rank_x, rank_y)) < used_x and when <= used_y:
                    known = False
                    break
                if right < 0 and left < 0:
                    break
                if rank_x >= rank_y and right >= 0:
                    used_x, x = rank_x, right
                else:
                    used_y, y = rank_y, left
            if len(self.neighbours) >= CACHE_PAIRS:
                self.neighbours.clear()
            self.neighbours[key] = known
        return known

    def _alone(self, word: str) -> tuple[int, ...]:
        """:meth:`_viterbi` of one long word, in time that grows with its length."""
        n, get = len(word), self.symbol.get
        last, back = [-1] * (n + 1), [1] * (n + 1)
        best = None if self.bpe else [0.0] + [-np.inf] * n
        for end in range(1, n + 1):
            for size in range(min(end, self.width), 0, -1):
                start = end - size
                piece = get(word[start:end])
                if piece is None:
                    continue
                if best is None:
                    if self.whole[piece] and (start == 0 or last[start] < 0 or self._apart(last[start], piece)):
                        last[end], back[end] = piece, size
                        break
                elif (gain := best[start] + self.score[piece]) > best[end]:
                    best[end], last[end], back[end] = gain, piece, size
            if best is not None and best[end] == -np.inf:
                best[end] = best[end - 1] - 1e6
        return self._path(word, last, back)

    def _path(self, word: str, last: list[int], back: list[int]) -> tuple[int, ...]:
        """The pieces of a word from its last end back to its start."""
        at, path = len(word), []
        while at:
            p = last[at]
            if 0 <= p < self.size:
                path.append(p)
            else:  # a character that is no piece
                path += reversed(self._spelled(word[at - 1]))
            at -= back[at]
        path.reverse()
        return tuple(path)

    def _viterbi(self, words: list[str]) -> list[tuple[int, ...]]:
        """Symbols of words of one length. All tables are laid out by position, then word."""
        n, length = len(words), len(words[0])
        h = np.ascontiguousarray(_hashes(_codes(words)).T)
        last = np.full((length + 1, n), NONE)
        back = np.ones((length + 1, n), np.int8)
        best = None if self.bpe else np.full((length + 1, n), -np.inf)
        if best is not None:
            best[0] = 0
        rows = np.arange(n)
        for end in range(1, length + 1):
            todo, here = rows, h[end]
            for size in range(min(end, self.width), 0, -1):
                start = end - size
                before = h[start] if todo is rows else h[start][todo]
                key = here - before * self.powers[size]
                seen = np.flatnonzero(self.maybe[key >> np.uint64(44)])
                if not len(seen):
                    continue
                key = key[seen]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[at] == key
                seen = seen[hit]
                who, piece = todo[seen], self.key_ids[at[hit]]
                if best is None:
                    fit = self.whole[piece]
                    if start:
                        fit &= self._stay_apart(np.where(fit, last[start][who], NONE), piece)
                    who = who[fit]
                    last[end][who] = piece[fit]
                    back[end][who] = size
                    rest = np.ones(len(todo), bool)
                    rest[seen[fit]] = False
                    todo, here = todo[rest], here[rest]
                    if not len(todo):
                        break
                else:
                    gain = best[start][who] + self.score[piece]
                    better = gain > best[end][who]
                    who, piece = who[better], piece[better]
                    best[end][who], last[end][who], back[end][who] = gain[better], piece, size
            if best is not None:
                none = np.isinf(best[end])  # no piece ends here: a character of its own, after the best path
                best[end][none] = best[end - 1][none] - 1e6
        return [self._path(word, ids, steps) for word, ids, steps in zip(words, last.T.tolist(), back.T.tolist(), strict=True)]

    def _spelled(self, char: str) -> tuple[int, ...]:
        """Byte pieces of a character, or the unknown piece if the model has none."""
        return tuple(self.bytes[b] for b in char.encode("utf-8", "surrogatepass")) if self.bytes else (self.unknown,)

    def _segments(self, units: list[str]) -> list[list[str]]:
        """The units cut between characters that no piece holds side by side."""
        joined = "".join(units)
        c = _codes([joined])[0].astype(np.int64)
        key = (c[:-1] << 21) | c[1:]
        at = np.minimum(np.searchsorted(self.together, key), len(self.together) - 1)
        cut = np.append(self.together[at] != key, True)
        ends = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))
        cut[ends - 1] = True
        stops = np.flatnonzero(cut) + 1
        parts = [joined[x:y] for x, y in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]
        upto = np.searchsorted(stops, ends, side="right").tolist()
        return [parts[x:y] for x, y in zip([0, *upto[:-1]], upto, strict=True)]

    def _learn(self, units: set[str]) -> None:
        ordered = list(units)
        split = dict(zip(ordered, self._segments(ordered), strict=True))
        by_length: dict[int, list[str]] = {}
        found = self.parts
        for s in set(chain.from_iterable(split.values())).difference(found):
            by_length.setdefault(len(s), []).append(s)
        for length, words in by_length.items():
            if length > LONG:
                found.update((w, self._alone(w)) for w in words)
                continue
            step = max(1, 400_000 // length)
            for at in range(0, len(words), step):
                found.update(zip(words[at : at + step], self._viterbi(words[at : at + step]), strict=True))
        for u, parts in split.items():
            self.cache[u] = found[parts[0]] if len(parts) == 1 else tuple(chain.from_iterable(map(found.__getitem__, parts)))

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text."""
        units = [UNIT.findall((SPACE_SIGN if self.prefix else "") + t.replace(" ", SPACE_SIGN)) if t else [] for t in texts]
        words = set().union(*units)
        new = words.difference(self.cache)  # a dict is probed here; its keys() would be walked as a whole
        if new:
            if len(self.cache) + len(new) > CACHE_WORDS:
                self.cache.clear()
                self.parts.clear()
                new = words
            self._learn(new)
        get = self.cache.__getitem__
        return [list(chain.from_iterable(map(get, u))) for u in units]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE_SIGN, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def model_of(path: str) -> PieceModel:
    """Tables of a model file, made once in each Python worker."""
    return PieceModel(path)


def encode(docs: DataFrame, model: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``ids``, in the scan's own tasks."""
    path = model or default_model()
    return map_texts(docs, lambda texts: [model_of(path).encode(texts)], "ids array<int>", keep=keep)


def decode(rows: DataFrame, model: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``decoded``, the text of the column ``ids`` (null: empty)."""
    path = model or default_model()
    return map_texts(rows, lambda ids: [[model_of(path).decode(i or []) for i in ids]], "decoded string", keep=keep, text="ids")


def digests(texts: list[str | None], path: str) -> list[list]:
    m = model_of(path)
    ids = m.encode(texts)
    back = [m.decode(i) for i in ids]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return [[len(i) for i in ids], [sha(struct.pack(f"<{len(i)}i", *i)) for i in ids], [sha(b.encode("utf-8", "surrogatepass")) for b in back], [b == (t or "") for b, t in zip(back, texts, strict=True)]]


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"


def pieces_query(docs: DataFrame, model: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (little-endian 32-bit ids), decoded_sha256, round_trip."""
    path = model or default_model()
    return map_texts(docs, lambda texts: digests(texts, path), DIGESTS, keep=keep)
