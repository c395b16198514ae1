"""Language ID, the language model and SentencePiece."""

import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
import sentencepiece

from calibron.llm import katz, langid, pieces


def test_language_accuracy_on_held_out_documents(prose):
    got = langid.language_query(prose).join(prose.select("doc_id", "lang"), "doc_id").toPandas()
    out = got[got.held_out]
    assert len(out) > 20 and (out.lang == out.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all() and got.rejected.mean() < 0.05
    assert set(got[got.held_out].doc_id) == {i for i in got.doc_id if zlib.crc32(str(i).encode()) % 4 == 2}


def test_language_prediction_ignores_labels_and_rejects_what_it_has_not_learned(spark, prose):
    model = langid.fit(prose.where(~langid.held_out_col()))
    strange = spark.createDataFrame([(1, "Ωδσφγ ηξκλπ θωερτ υιοπα", "en"), (2, None, "en"), (3, "123 !!!", "de"), (4, "", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(strange, model).collect()}
    assert all(got[k].rejected for k in got) and [got[k].lang_pred for k in (2, 3, 4)] == ["und"] * 3
    a = langid.predict(prose, model).drop("doc_id").collect()
    assert a == langid.predict(prose.selectExpr("doc_id + 7 as doc_id", "text", "'xx' as lang"), model).drop("doc_id").collect()


UNLEARNED = {
    "it": "Il governo ha annunciato ieri una nuova serie di misure per sostenere le famiglie e le imprese che soffrono a causa della crisi economica degli ultimi anni.",
    "pl": "Rząd ogłosił wczoraj nowy pakiet środków wspierających rodziny oraz przedsiębiorstwa dotknięte skutkami kryzysu gospodarczego ostatnich lat w całym kraju.",
    "nl": "De regering heeft gisteren een nieuwe reeks maatregelen aangekondigd om gezinnen en bedrijven te ondersteunen die lijden onder de economische crisis.",
    "fi": "Hallitus ilmoitti eilen uudesta toimenpidekokonaisuudesta, jolla tuetaan talouskriisistä kärsiviä perheitä ja yrityksiä koko maassa viime vuosina.",
    "tr": "Hükümet dün ekonomik krizden etkilenen aileleri ve işletmeleri desteklemek için yeni bir önlem paketi açıkladı ve bunun yakında uygulanacağını söyledi.",
    "base64": "qL3vTzXw9Kp0RbYh2NcUeJ7sMgAoQdFi5WlBtEyHxZrVnGuCkPaSjOmDfIqLwTz8XeRbKhNvYcUsJgMaQoFdWiBlEtHyZxVrGnCuPkSaOjDmIf",
}


def test_latin_languages_that_were_not_learned_are_rejected(spark, prose):
    model = langid.fit(prose.where(~langid.held_out_col()))
    texts = [" ".join([t] * n) for t in UNLEARNED.values() for n in (1, 6)]
    assert all(model.predict(texts)[2])
    held = prose.where(langid.held_out_col()).select("text").toPandas()["text"].tolist()
    assert model.predict(held)[2].mean() <= 0.02
    assert model.predict([t[:40] for t in held])[2].mean() <= 0.05  # short clean texts stay


def test_language_awkward_and_empty(awkward, nothing):
    assert langid.language_query(awkward).count() == awkward.count()
    assert langid.language_query(nothing).count() == 0
    kept = langid.drop_rejected(awkward)
    assert kept.columns == awkward.columns and 0 < kept.count() < awkward.count()


def tokens_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + ["\0"]


@pytest.mark.parametrize(("block_bytes", "hot"), [(katz.BLOCK_BYTES, None), (5_000, 40)])
def test_katz_equals_brute_force_and_sums_to_one(documents, block_bytes, hot):
    model, scores = katz.trained(documents.select("doc_id", "text").withColumn("held", katz.held_out_col()), block_bytes, hot)
    got = {r.doc_id: r for r in scores.collect()}
    texts = {r.doc_id: tokens_of(r.text) for r in documents.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    one, two, context = collections.Counter(), collections.Counter(), collections.Counter()
    for i, t in texts.items():
        if not held[i]:
            one.update(t)
            for h, w in itertools.pairwise([" ", *t]):
                two[h, w] += 1
                context[h] += 1
    n, v = sum(one.values()), len(one)
    p = lambda w: (one[w] + 0.5) / (n + 0.5 * (v + 1))
    of = collections.Counter(two.values())
    d = katz.discounts(np.array([of[r] for r in range(1, 7)], float))
    kept, seen = collections.Counter(), collections.Counter()
    for (h, w), c in two.items():
        kept[h] += d[min(c, 6)] * c
        seen[h] += p(w)

    def prob(h, w):
        if not context[h]:
            return p(w)
        left = context[h] - kept[h]
        more = left < 1e-6
        below = context[h] + more
        return d[min(two[h, w], 6)] * two[h, w] / below if two[h, w] else (1 if more else left) / below / (1 - seen[h]) * p(w)

    for i, t in texts.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, model.tokens) == (held[i], len(t), sum(one[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10(p(w)) for w in t), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(prob(h, w)) for h, w in itertools.pairwise([" ", *t])), rel_tol=1e-9)
    for h in list(context)[:20]:
        assert math.isclose(sum(prob(h, w) for w in one) + prob(h, "never seen"), 1, rel_tol=1e-9)


@pytest.mark.parametrize("hot", [None, 40])
def test_katz_scores_any_text_from_its_tables(spark, documents, hot):
    held = documents.select("doc_id", "text").withColumn("held", katz.held_out_col())
    model, scores = katz.trained(held, 5_000, hot)
    again = katz.score_texts(held.drop("held"), model)
    want = {r.doc_id: (r.n_tokens, r.n_known, r.base_score, r.score) for r in scores.collect()}
    got = {r.doc_id: (r.n_tokens, r.n_known, r.base_score, r.score) for r in again.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    new = spark.createDataFrame([(1, "entirely unknown wordsonly"), (2, None), (3, "lorem unknown2 ipsum dolor lorem")], "doc_id long, text string")
    rows = {r.doc_id: r for r in katz.score_texts(new, model).collect()}
    assert rows[1].n_known == 1 and rows[2].n_tokens == 1 and all(math.isfinite(r.score) for r in rows.values())
    parts = [r.n for r in model.contexts.groupBy("pairs").count().withColumnRenamed("count", "n").collect()]
    assert max(parts) == 1 and katz.fitted(documents).tokens > model.tokens


def test_katz_awkward_and_empty(awkward, nothing, spark):
    assert katz.katz_query(awkward).count() == awkward.count()
    assert katz.katz_query(nothing).count() == 0
    only_held = spark.createDataFrame([(i, "a b c") for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1], "doc_id long, text string")
    rows = katz.katz_query(only_held).collect()
    assert rows and all(r.n_known == 0 and math.isfinite(r.score) for r in rows)


TEXTS = ["", " ", "   a  b ", "a" * 40, " \n\n\t x", "\u4f60\u597d h\u00e9\u00e9\U0001f600", "internationalization " * 3, "        if x:\n                return\n", "1234567890" * 5, "==========-----////", "e" * 3000]


def test_pieces_equal_the_library(prose):
    model = pieces.model_of(pieces.default_model())
    texts = TEXTS + [r.text for r in prose.collect()]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    ids = model.encode(texts)
    assert ids == library.encode(texts)
    assert [model.decode(i) for i in ids] == texts


def test_unigram_viterbi_equals_brute_force():
    rows = [("<unk>", 0.0, 2)] + [(w, s, 1) for w, s in (("a", -3.0), ("b", -3.2), ("ab", -4.0), ("ba", -4.5), ("aba", -5.6), ("bb", -7.0), ("\u2581", -2.0), ("\u2581a", -3.1))]
    model = pieces.PieceModel.of(rows, bpe=False)
    score = {w: s for w, s, kind in rows if kind == 1}

    def best(word):
        ways = []
        for cuts in itertools.product((0, 1), repeat=len(word) - 1):
            edges = [0, *(k + 1 for k, c in enumerate(cuts) if c), len(word)]
            parts = [word[a:b] for a, b in itertools.pairwise(edges)]
            if all(q in score for q in parts):
                ways.append(sum(score[q] for q in parts))
        return max(ways)

    for n in range(1, 7):
        for letters in itertools.product("ab", repeat=n):
            word = "".join(letters)
            ids = model.encode([word])[0]
            assert math.isclose(sum(rows[i][1] for i in ids), best("\u2581" + word))
            assert model.decode(ids) == word
    assert model.encode(["azb"])[0].count(0) == 1


def test_pieces_query_awkward_and_empty(awkward, nothing):
    rows = pieces.pieces_query(awkward).collect()
    assert len(rows) == awkward.count() and all(r.round_trip for r in rows)
    none = [r for r in rows if r.doc_id == 300][0]
    assert none.n_tokens == 0 and none.ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert pieces.pieces_query(nothing).count() == 0
    back = {r.doc_id: r.decoded for r in pieces.decode(pieces.encode(awkward)).collect()}
    assert back[306] == "one" and back[300] == ""


def test_long_words_equal_the_library_in_proportional_time():
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    model = pieces.model_of(pieces.default_model())
    rng = random.Random(8)
    texts = ["=" * 100_000, "-=" * 20_000, "a" + " " * 30_000 + "b", "\n" * 30_000, "".join(rng.choice(["=", "--", "_", "ab", "the", "XX", "0", "é", "日"]) for _ in range(20_000))]
    texts += ["".join(rng.choice(["=", "--", "_", "ab", "ing", "0", "é"]) for _ in range(rng.randint(200, 900))) for _ in range(60)]
    assert model.encode(texts) == library.encode(texts)
    began = time.time()
    assert len(model.encode(["=" * 1_000_000])[0]) > 0
    assert time.time() - began < 90


@pytest.mark.parametrize("bpe", [False, True])
def test_a_word_alone_is_as_among_others(bpe, monkeypatch):
    rng = random.Random(12)
    rows = [("<unk>", 0.0, 2)] + [(c, -5.0 - k, 1) for k, c in enumerate("ab▁")]
    rows += [("aa", -1.0, 1), ("ab", -2.0, 1), ("aab", -2.5, 1), ("aaaa", -3.0, 1), ("ba", -3.5, 1), ("abab", -4.0, 1)]
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 40))) for _ in range(80)]
    want = pieces.PieceModel.of(rows, bpe=bpe).encode(texts)
    monkeypatch.setattr(pieces, "LONG", 0)
    assert pieces.PieceModel.of(rows, bpe=bpe).encode(texts) == want
