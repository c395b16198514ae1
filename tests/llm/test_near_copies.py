"""SimHash groups, repeated strings and Order MinHash against brute force."""

import hashlib
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from calibron.llm import order_minhash, simhash, suffix_dedup


def brute_simhash(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(rows):
    fp = {i: brute_simhash(t) for i, t in rows}
    ids = sorted(fp)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(fp[a] ^ fp[b]).count("1") <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (f"{fp[i]:016x}", find(i)) for i in ids}


def test_simhash_groups_equal_brute_force(documents, prose):
    for docs in (documents, prose):
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_query(docs).collect()}
        assert got == brute_groups([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_trie_finds_all_pairs_within_the_budget():
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**63, 6).astype(np.uint64)
    flips = lambda: np.uint64(1) << rng.integers(0, 64, (6, 50)).astype(np.uint64)
    x = np.unique(np.concatenate([rng.integers(0, 2**63, 200).astype(np.uint64), (seeds[:, None] ^ flips() ^ flips()).ravel()]))
    diff = x[:, None] ^ x[None, :]
    near = (np.bitwise_count(diff) <= 4) & (np.bitwise_count(diff >> np.uint64(32)) <= 2)
    got = {p for i, j in simhash.trie_pairs(x, (np.array([0]), np.array([len(x)]), np.array([0]), np.array([len(x)])), ((32, 2), (64, 4)), most=64) for p in zip(i.tolist(), j.tolist(), strict=True)}
    assert got == {(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j}


def linked(edges):
    """Groups of two or more that the edges join."""
    group = {}
    for r in edges.collect():
        both = group.setdefault(r.a, {r.a}) | group.setdefault(r.b, {r.b})
        for x in both:
            group[x] = both
    return {frozenset(g) for g in group.values()}


def test_blocks_and_depth_of_the_trie_lose_no_link(spark):
    rng = np.random.default_rng(5)
    flipped = lambda x, most: x ^ sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(0, most + 1))))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    centres = [int(x) for x in rng.integers(0, 2**63, 12)]
    fps = sorted({flipped(c, 3) for c in centres for _ in range(25)})
    narrow = spark.createDataFrame([(signed(f), k) for k, f in enumerate(fps)], "fp long, rep long")
    whole = linked(simhash.near_edges(narrow))
    brute = {frozenset({i for i, f in enumerate(fps) if (f ^ c).bit_count() <= 3}) for c in centres}
    assert {g for g in brute if len(g) > 1} and all(any(len(g & h) > 1 for h in whole) for g in brute)
    assert linked(simhash.near_edges(narrow, node_rows=3)) == whole
    assert linked(simhash.near_edges(narrow, leaf_rows=1)) == whole
    assert linked(simhash.near_edges(narrow, leaf_rows=0.1)) == whole  # 12 levels
    assert linked(simhash.near_edges(narrow, leaf_rows=0.001, node_rows=2)) == whole  # 18 levels, by halves
    wide = [tuple(signed(flipped(int(w), 8)) for w in four) for four in rng.integers(0, 2**63, (8, 4)) for _ in range(20)]
    rows = spark.createDataFrame([(*w, k) for k, w in enumerate(wide)], "w0 long, w1 long, w2 long, w3 long, rep long")
    whole = linked(simhash.similar_edges(rows))
    assert len(whole) == 8
    assert linked(simhash.similar_edges(rows, node_rows=4)) == whole
    assert linked(simhash.similar_edges(rows, leaf_rows=0.3)) == whole  # 10 levels


def test_simhash_awkward_and_empty(awkward, nothing):
    rows = simhash.simhash_query(awkward).collect()
    assert len(rows) == awkward.count()
    assert {r.component_id for r in rows if r.doc_id == 306} == {306}
    assert simhash.simhash_query(nothing).count() == 0
    kept = simhash.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns and kept.where("doc_id is null").count() == 1


def test_similar_groups_find_copies_of_similarity_08_and_leave_others(spark, prose):
    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    rows = [(r.doc_id, r.text) for r in prose.select("doc_id", "text").collect()]
    rng = random.Random(2)
    made = []
    for k, (_, text) in enumerate(rows[:40]):
        words = text.split()
        if len(words) > 60:
            for at in rng.sample(range(len(words)), max(1, len(words) // 60)):
                words[at] = f"changed{k}"
            made.append((100_000 + k, " ".join(words)))
    docs = spark.createDataFrame(rows + made, "doc_id long, text string")
    group = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    sets = {i: shingles(t) for i, t in rows + made}
    found = total = 0
    for i in sets:
        for j in sets:
            if i < j:
                alike_ = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
                total += alike_ >= 0.8
                found += alike_ >= 0.8 and group[i] == group[j]
                if len(sets[i]) > 30 and len(sets[j]) > 30:
                    assert alike_ > 0.4 or group[i] != group[j]
    assert total > 10 and found >= 0.95 * total


def test_similar_groups_confirm_by_exact_similarity(spark):
    rng = random.Random(11)
    text = lambda words: " ".join(words)
    rows, wants = [], {}
    for k, share in enumerate([0.8] * 60 + [0.79, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5] * 20):
        n = rng.choice([16, 60, 200])
        common = round(2 * n * share / (1 + share))  # one tail replaced: shared / (2 n - shared)
        words = [f"w{rng.randrange(10**9)}" for _ in range(n + 4)]
        other = words[: common + 4] + [f"v{rng.randrange(10**9)}" for _ in range(n - common)]
        rows += [(2 * k, text(words)), (2 * k + 1, text(other))]
        wants[k] = common / (2 * n - common) >= 0.8
    group = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked_ = {k for k in wants if group[2 * k + 1] == 2 * k}
    assert not {k for k in linked_ if not wants[k]}
    assert len(linked_) >= 0.99 * sum(wants.values()) and sum(wants.values()) > 20


def brute_repeats(rows):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone, strict=True) if not y)).hexdigest())
    return out


def test_repeats_equal_brute_force(spark, documents, prose):
    rng = random.Random(1)
    base = "".join(rng.choice("abcdé \n") for _ in range(2000))
    made = []
    for k in range(60):
        t = ""
        for _ in range(rng.randint(0, 5)):
            a = rng.randint(0, 1800)
            t += base[a : a + rng.choice([40, 99, 100, 101, 150, 300])] if rng.random() < 0.7 else "".join(rng.choice("xyz") for _ in range(rng.randint(1, 80)))
        made.append((k * 7 % 61, t))
    made += [(90, "a" * 400), (91, "a" * 99), (92, None), (93, ""), (94, "ab" * 200), (95, "a" * 100)]
    crafted = spark.createDataFrame(made, "doc_id long, text string")
    for docs, hot in ((crafted, 20_000), (crafted, 1), (documents, 20_000), (prose, 20_000)):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_query(docs, hot).collect()}
        assert got == brute_repeats([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_repeats_in_pieces_awkward_and_empty(awkward, documents, nothing, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 1 << 22)
    assert suffix_dedup.suffix_query(awkward).count() == awkward.count()
    assert suffix_dedup.suffix_query(nothing).count() == 0
    raw = np.frombuffer(b"abc" * 500, np.uint8)
    monkeypatch.setattr(suffix_dedup, "PIECE", 333)
    starts = [a + s for a, piece in suffix_dedup._pieces(raw) for s in range(len(piece) - 99)]
    assert starts == list(range(len(raw) - 99))


def omh_signature(text):
    def chain(parts):
        seed = 42
        for p in parts:
            seed = xxhash.xxh64_intdigest(p, seed)
        return seed

    low = order_minhash.PLACE
    tokens = [t.encode() for t in re.findall(order_minhash.TOKEN, text)]
    k = [chain(tokens[i : i + 2]) for i in range(len(tokens) - 1)] or ([chain([b" ".join(tokens)])] if tokens else [])
    seen, packed = {}, []
    for i, h in enumerate(k):
        c = seen[h >> 28] = seen.get(h >> 28, -1) + 1
        packed.append(chain([(h >> 28).to_bytes(8, "little"), c.to_bytes(4, "little")]) & ~low | i)
    ring = sorted((x - (1 << 64) if x >> 63 else x) for x in packed)
    out = []
    for b in range(-32, 32 if ring else -32):
        after = [x for x in ring if x >> 58 >= b] + ring
        places = sorted({x & low for x in after[:2]})
        out.append(max(1, chain([k[p].to_bytes(8, "little") for p in places]) & 0x7FFFFFFF))
    return out or [0] * 64


def alike(a, b):
    used = sum(x != 0 or y != 0 for x, y in zip(a, b, strict=True))
    return sum(x == y != 0 for x, y in zip(a, b, strict=True)) / used if used else 1.0


def test_order_minhash_equals_brute_force(documents):
    rows = sorted(((r.doc_id, r.text or "") for r in documents.collect()), key=lambda r: r[0])
    got = {r.doc_id: r for r in order_minhash.minhash_query(documents).collect()}
    for n, (i, text) in enumerate(rows):
        following = rows[(n + 1) % len(rows)][1]
        edited = text[: len(text) - len(text) // 4] + following[: len(text) // 4]
        own, other, after = omh_signature(text), omh_signature(edited), omh_signature(following)
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == tuple("".join(f"{c:08x}" for c in s) for s in (own, other))
        assert abs(r.near_edited - alike(own, other)) < 1e-12 and abs(r.near_next - alike(own, after)) < 1e-12


def test_order_minhash_sees_order_and_awkward_tables(spark, awkward, nothing):
    words = [f"w{i}" for i in range(400)]
    texts = [(1, " ".join(words)), (2, " ".join(words[:390] + ["new"] + words[390:])), (3, " ".join(reversed(words)))]
    sig = {r.doc_id: r.fingerprint for r in order_minhash.fingerprints(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    same = lambda a, b: sum(sig[a][k : k + 8] == sig[b][k : k + 8] for k in range(0, 512, 8))
    assert same(1, 2) > 50 and same(1, 3) < 5
    assert order_minhash.minhash_query(awkward).count() == awkward.count()
    assert order_minhash.minhash_query(nothing).count() == 0


def test_order_minhash_sees_the_order_of_short_texts(spark):
    rng = random.Random(8)
    texts = []
    for i in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(20, 60))]
        half = len(words) // 2
        texts += [(i, 0, " ".join(words)), (i, 1, " ".join(words[half:] + words[:half])), (i, 2, " ".join(words[:half] + ["new"] + words[half:]))]
    docs = spark.createDataFrame(texts, "id int, form int, text string").withColumn("sig", order_minhash.signature(F.col("text")))
    own, other = docs.where("form = 0").select("id", F.col("sig").alias("own")), docs.where("form > 0")
    mean = {r.form: r.m for r in other.join(own, "id").groupBy("form").agg(F.avg(order_minhash.likeness(F.col("own"), F.col("sig"))).alias("m")).collect()}
    assert mean[1] < 0.6 and mean[2] > 0.8, mean


def test_exact_stage_in_blocks_and_without_matrix_equals_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    rows = []
    for g in range(4):
        base = [f"w{g}_{k}" for k in range(120)]
        for c in range(12):
            words = list(base)
            for at in rng.sample(range(120), rng.randint(1, 9)):
                words[at] = f"c{g}{c}{at}"
            rows.append((g * 12 + c, " ".join(words)))
    sets = {i: simhash.shingle_set(t) for i, t in rows}
    want = {frozenset({i}) for i in sets}
    for i in sets:
        for j in sets:
            if i < j and len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.8:
                a, b = (next(g for g in want if x in g) for x in (i, j))
                want = (want - {a, b}) | {a | b}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wide = [(i, *simhash.wide_fingerprint(s)) for i, s in sets.items()]
    classes = spark.createDataFrame(wide, "rep long, w0 long, w1 long, w2 long, w3 long")
    assert linked(simhash.confirmed_edges(docs, classes)) == {g for g in want if len(g) > 1}
    assert linked(simhash.confirmed_edges(docs, classes, unit_shingles=400)) == {g for g in want if len(g) > 1}
    plain, bits = simhash.Sets(list(sets.values())), simhash.Sets(list(sets.values()))
    plain.bits = None
    i, j = np.triu_indices(len(sets), 1)
    assert (plain.common(i, j) == bits.common(i, j)).all() and bits.bits is not None


def test_views_find_pairs_at_the_limit():
    """Recall of the walk alone over simulated pairs at 0.8: each view's budgets applied to the pair's bits."""
    rng = np.random.default_rng(6)
    for rows in (1000, 3_000_000, 200_000_000):
        depth, views, budgets = simhash.similar_plan(rows)
        found = 0
        for _ in range(300):
            core, rest = rng.integers(0, 2**63, 160).astype(np.uint64), rng.integers(0, 2**63, 40).astype(np.uint64)
            a, b = (np.array([simhash.wide_fingerprint(np.unique(np.concatenate((core, r))))], np.int64).view(np.uint64) for r in (rest[:20], rest[20:]))
            diff = lambda t: int(simhash.view_keys(a, t, depth)[0] ^ simhash.view_keys(b, t, depth)[0])
            found += any(all((d >> (64 - k)).bit_count() <= e for k, e in budgets) for d in map(diff, range(views)))
        assert found >= 297, (rows, found)
