"""Token alignment, whitening and packing against brute force and the libraries."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from calibron.llm import alignment, packing, whitening

ODD = [
    "a \n\nb", "x 　 y", "tab\t tab", "  two  spaces  ", "\n", " ", "   ", "trailing ", "a\x1c b\x1c\x1d c", "line\r\n  next\n\n\n  end", "<|endoftext|> and <s> </s> <unk>", "<|startoftext|>word<|endoftext|>",
    "under▁score", "▁", "café CAFÉ İstanbul ΣΑΣ", "日本語 テキスト 🙂🙃 👩‍👩‍👧", "it's we'll 's 't don''t", "=" * 5000, "ab" * 4000, "12 345 6.7", "\u0000\u0001x", "﻿bom", "word next   after", "!\x1c bar\u0085 z",
]


def odd_texts() -> list:
    rng = random.Random(3)
    parts = ["foo", "Bar", " ", "  ", "\n", "\t", " ", "　", "é", "é", "'s", "!?", "12", "\x1c", "🙂", "the", "▁", "_", "zzzz"]
    return ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(300)]


@pytest.fixture(scope="module")
def odd(spark, documents):
    extra = [(1000 + k, t, "en", "odd", len(t)) for k, t in enumerate(odd_texts())]
    rows = documents.unionByName(spark.createDataFrame(extra, documents.schema))
    return rows.withColumn("k0", F.lit("clash")).withColumn("block", F.lit("clash")).withColumn("part", F.lit("clash"))


def brute_alignment(rows):
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(x): x for x in plain} | {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in plain)}
    found = []
    for doc, text in rows:
        groups = []
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            raw_a = [bytes(of[c] for c in a.id_to_token(i)) for i in ids_a]
            raw_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in (b.id_to_piece(i),)]
            if b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
                ends = [list(np.cumsum([len(r) for r in raw]).tolist()) for raw in (raw_a, raw_b)]
                cuts = sorted(set(ends[0]) & set(ends[1]))
                x = y = 0
                for c in cuts:
                    i, j = ends[0].index(c, x) + 1, ends[1].index(c, y) + 1
                    groups.append((ids_a[x:i], ids_b[y:j]))
                    x, y = i, j
        found.append((doc, groups))
    links = [[(p, q) for g in groups for p in g[0] for q in g[1]] for _, groups in found]
    counts = Counter(pair for each in links for pair in set(each))
    top = defaultdict(int)
    for (p, _), n in counts.items():
        top[p] = max(top[p], n)
    out = []
    for (doc, groups), each in zip(found, links, strict=True):
        text = ";".join(f"{','.join(map(str, g[0]))}|{','.join(map(str, g[1]))}" for g in groups)
        out.append((doc, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(each), sum(counts[p] == top[p[0]] for p in each), sum(counts[p] for p in each), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out, counts, top, dict(found)


def by_key(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def test_alignment_is_brute_force(odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    want, counts, top, groups = brute_alignment(rows)
    got = alignment.alignment_query(odd)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got.columns == names
    assert by_key(map(tuple, got.collect())) == by_key(want)
    assert {(r.a, r.b): (r.n_docs, r.best) for r in alignment.link_table(odd).collect()} == {p: (n, n == top[p[0]]) for p, n in counts.items()}
    for r in alignment.token_groups(odd).collect():
        assert [(list(g["a"]), list(g["b"])) for g in r.groups] == groups[r.doc_id]


def test_alignment_of_blocks_is_that_of_one(odd, monkeypatch):
    whole = by_key(map(tuple, alignment.alignment_query(odd).collect()))
    monkeypatch.setattr(alignment, "BLOCK_CHARS", 2000)
    monkeypatch.setattr(alignment, "CACHE_UNITS", 50)
    monkeypatch.setattr(alignment, "WIDE", 2)
    alignment.units_from.cache_clear()
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    units = alignment.Units(*alignment.default_tokenizers())
    blocks, asks = [], []
    block = alignment.Block(units)
    for doc, text in rows:
        block.add([(doc,)], [text])
        if block.chars >= 2000:
            row, some = block.rows(len(blocks), 4)
            blocks.append(row)
            asks += some
            units.clear()
            block = alignment.Block(units)
    row, some = block.rows(len(blocks), 4)
    blocks.append(row)
    stats = [(k[0], *s) for b in blocks for k, s in zip(b["docs"], b["stats"].tolist(), strict=True)]
    assert by_key(stats) == by_key([r[:5] for r in whole])
    assert len(blocks) > 5 and {a["bucket"] for a in asks} == {0, 1, 2, 3}


def test_bitsets_select_and_rank():
    rng = np.random.default_rng(1)
    for size in (1, 63, 64, 65, 1000):
        at = np.flatnonzero(rng.random(size) < 0.3)
        bits = alignment.packed_bits(at, size)
        assert alignment.selected(bits).tolist() == at.tolist()
        every = np.arange(size)
        assert alignment.rank(bits, every).tolist() == [(at <= p).sum() for p in every]


def test_alignment_of_awkward_and_empty_tables(awkward, nothing):
    assert alignment.alignment_query(awkward).count() == awkward.count()
    assert alignment.alignment_query(nothing).collect() == []
    kept = alignment.aligned(awkward, keep=("doc_id", "block", "text")).where("doc_id = 300").collect()
    assert [(r.block, r.text, r.n_a, r.groups_sha256) for r in kept] == [("clash block", None, 0, "")]


def brute_whitening(rows):
    good = [(k, [float(c) for c in v]) for k, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max((len(v) for _, v in good), default=0)
    x = [(k, [int(np.floor(64 * c)) + 1_000_000 for c in v] + [1_000_000] * (width - len(v))) for k, v in good]
    fit = sorted({tuple(v) for _, v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in fit])
    e, vec = np.linalg.eigh(centred.T @ centred / n)
    e, vec = e[::-1], vec[:, ::-1]
    out = {}
    for k, v in x:
        off = [n * c - s for c, s in zip(v, sums, strict=True)]
        out.setdefault(k, []).append((sum(o * o for o in off), np.array(off) / n @ vec[:, :16] / np.sqrt(np.maximum(e[:16], 1e-300))))
    return n, e, out


def held_against_brute(rows, got):
    n, e, want = brute_whitening(rows)
    found = defaultdict(dict)
    for r in got:
        assert r.n == n and 0 <= r.identity_error <= 1e-4
        assert r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-6)
        found[r.vec_id].setdefault(r.component, []).append((r.deviation, r.whitened))
    assert set(found) == set(want)
    signs = {}
    for key, cells in want.items():
        for k, values in found[key].items():
            theirs = sorted((d, abs(float(z[k - 1]))) for d, z in cells)
            assert [d for d, _ in theirs] == [d for d, _ in sorted(values)]
            np.testing.assert_allclose(sorted(abs(v) for _, v in values), sorted(v for _, v in theirs), atol=1e-6)
            if len(values) == 1 and abs(values[0][1]) > 1e-6:
                assert signs.setdefault(k, np.sign(values[0][1] * cells[0][1][k - 1])) == np.sign(values[0][1] * cells[0][1][k - 1])
    return found


def test_whitening_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    monkeypatch.setattr(whitening, "ROWS", 7)
    rng = np.random.default_rng(5)
    base = (rng.normal(size=(300, 24)) * np.linspace(3, 0.5, 24)).astype(np.float32).tolist()
    rows = [(k, v) for k, v in enumerate(base)] + [(500 + k, base[0]) for k in range(150)]
    rows += [(900, None), (901, [None] + base[1][1:]), (902, [float("nan")] + base[1][1:]), (903, [float("-inf")] + base[1][1:]), (None, base[2]), (904, base[3][:20]), (904, base[3]), (905, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(9).withColumn("x", F.lit("clash")).withColumn("whitened", F.lit(1))
    got = whitening.whitening_query(df).collect()
    assert [c for c in whitening.whitening_query(df).columns] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert all(len(v) == 16 for v in held_against_brute(rows, got).values())


def test_whitening_of_the_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    held_against_brute(rows, whitening.whitening_query(df).collect())


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whitening_query(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whitening_query(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect() == []
    line = whitening.whitening_query(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [1e300, 0.0]), (3, [1e300, 0.0])], schema)).collect()
    assert {r.component for r in line} == {1} or {r.component for r in line} == {1, 2}
    flat = whitening.whitening_query(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.0])], schema)).collect()
    assert [(r.vec_id, r.component, r.deviation, round(abs(r.whitened), 9)) for r in sorted(flat)] == [(1, 1, 64**2 + 128**2, 1.0), (2, 1, 64**2 + 128**2, 1.0)]


def packed_rows(df, size, ids):
    """Checks that pieces cover their documents and sequences have no gaps; the number of sequences."""
    bins, docs = defaultdict(list), defaultdict(list)
    for r in df.collect():
        bins[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append(r)
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and 0 < length <= size
            at += length
        assert at <= size
    want = Counter((doc, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())) for doc, whole in ids for n, at in enumerate(range(0, len(whole), size)) for part in (whole[at : at + size],))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for rows in docs.values() for r in rows) == want
    return len(bins)


def library_ids(df):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [(r.doc_id, [*t.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in df.select("doc_id", "text").collect()]


def test_packing_covers_every_document(odd, awkward):
    for df in (odd, awkward.repartition(40)):
        ids = library_ids(df)
        n = packed_rows(packing.packing_query(df), 4096, ids)
        assert n <= -(-sum(len(i) for _, i in ids) // 4096) + 1
    assert packing.packing_query(awkward).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_packing_in_rounds_with_few_bins(prose, monkeypatch):
    monkeypatch.setattr(packing, "FAN", 2)
    df = prose.repartition(7)
    ids = library_ids(df)
    low = -(-sum(len(i) for _, i in ids) // 512)
    assert low <= packed_rows(packing.packed(df, size=512, bins=8), 512, ids) <= low * 1.1
    assert low <= packed_rows(packing.packed(df, size=512, bins=1), 512, ids)


def test_packed_sequences_give_texts_back(prose):
    whole = packing.sequences(prose, size=512).collect()
    assert all(r.n_tokens * 4 == len(r.ids) <= 4 * 512 for r in whole)
    found = Counter(i for r in whole for i in np.frombuffer(r.ids, "<u4").tolist())
    assert found == Counter(i for _, ids in library_ids(prose) for i in ids)


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    closed = []
    fit = packing.BestFit(10, 2, closed.append)
    for name, length in (("a", 6), ("b", 7), ("c", 3), ("d", 4), ("e", 9), ("f", 8), ("g", 7)):
        fit.put(name, length)
    # c fills b, d fills a; e and f are open when g needs a bin, and e is the fuller one
    assert closed == [["b", "c"], ["a", "d"], ["e"]] and fit.rest() == [["f"], ["g"]]
    fit.shrink(0)
    assert closed[3:] == [["f"], ["g"]] and fit.open == 0 and fit.free == 0


def test_packing_of_an_empty_table(nothing):
    assert packing.packing_query(nothing).collect() == []
