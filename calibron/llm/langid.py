"""Language identification by the nearest of several TF-IDF centroids for each language.

Text is lower-cased, everything but letters becomes one space, and character 1- to 3-grams are hashed
into ``DIMS`` dimensions. Vectors are (1 + log tf) * idf, of length one. The document frequencies cover
all training documents; centroids come from spherical k-means over a bounded sample of each language
(``sample_per_lang`` documents, those with the smallest hash of doc_id). A document takes the language
of the centroid with the largest cosine, and is rejected if it is farther from it than the sample of
that language allows texts of its length to be (``floors_of``).

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected; so is
everything where nothing can be learned (no labelled training rows). Ties go to the smaller language
name. Rows with equal doc_id are each predicted; a null doc_id counts as not held out but is not
learned from. lang, source and doc_id never enter a prediction.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibron.llm.common import columns_of, map_texts

DIMS = 1 << 13
NOT_LETTERS = re.compile(r"[\W\d_]+")
FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
SALTS = np.array([0x27D4EB2F, 0x165667B1, 0x68E31DA4], np.uint32)


def held_out_col() -> F.Column:
    """Whether crc32 of the doc_id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def cleaned(texts: list[str | None]) -> list[str]:
    """Lower-cased words of letters, each a space apart."""
    return [NOT_LETTERS.sub(" ", (t or "").lower()).strip() for t in texts]


def counts_of(clean: list[str]) -> np.ndarray:
    """Counts of the hashed n-grams, a row for each cleaned text."""
    out = np.zeros((len(clean), DIMS), np.float32)
    for row, text in enumerate(clean):
        if not text:
            continue
        c = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        acc = np.zeros(len(c), np.uint32)
        for k in range(min(3, len(c))):
            acc = (acc[: len(c) - k] + c[k:] * FACTORS[k]) * np.uint32(0x2C1B3C6D)
            code = (acc ^ SALTS[k]) >> np.uint32(19)
            out[row] += np.bincount(code, minlength=DIMS)
    return out


def vectors_of(clean: list[str], idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors of cleaned texts; zero for texts without letters."""
    tf = counts_of(clean)
    v = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * idf
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def cluster(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of spherical k-means from k-means++ seeds; those of a single row are dropped if others are left."""
    rng = np.random.default_rng(0)
    seeds = [x[int(np.argmax(x @ x.mean(axis=0)))]]
    best = x @ seeds[0]
    while len(seeds) < min(k, len(x)):
        far = np.clip(1 - best.astype(np.float64), 0, None)
        if far.sum() < 1e-6 * len(x):
            break
        seeds.append(x[int(rng.choice(len(x), p=far / far.sum()))])
        best = np.maximum(best, x @ seeds[-1])
    c = np.stack(seeds)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        for j in range(len(c)):
            if (own == j).any():
                m = x[own == j].mean(axis=0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    members = np.bincount(np.argmax(x @ c.T, axis=1), minlength=len(c))
    return c[members > 1] if (members > 1).any() else c[members > 0]


#: Letters of distinct words for which floors are found; a text takes the floor of the largest that it reaches.
LENGTHS = np.array([4, 8, 16, 32, 64, 128, 256])
#: Characters of a sampled text that floors are found from.
HEAD = 4096


def letters_of(text: str) -> int:
    """Letters of the distinct words of a cleaned text: repeating a word makes no text longer."""
    return sum(map(len, set(text.split(" "))))


def cut_to(text: str, n: int) -> str | None:
    """The beginning of a cleaned text whose distinct words have ``n`` letters, None if it has fewer."""
    seen, letters, words = set(), 0, []
    for w in text.split(" "):
        words.append(w)
        if w not in seen:
            seen.add(w)
            letters += len(w)
            if letters >= n:
                words[-1] = w[: len(w) - (letters - n)]
                return " ".join(words)
    return None


def floors_of(x: np.ndarray, heads: list[str], idf: np.ndarray, k: int, slack: float) -> np.ndarray:
    """For each of ``LENGTHS``, ``slack`` times the 1% quantile of the cosines of a language's sample cut to it.

    Each half of the sample is held against centroids of the other half. A sample of one text allows everything.
    """
    out = np.zeros(len(LENGTHS))
    if len(x) < 2:
        return out
    halves = [cluster(x[1 - h :: 2], k) for h in (0, 1)]
    for at, n in enumerate(LENGTHS):
        cut = [[c for t in heads[h::2] if (c := cut_to(t, n)) is not None] for h in (0, 1)]
        cosines = [(vectors_of(t, idf) @ c.T).max(axis=1) for t, c in zip(cut, halves, strict=True) if t]
        out[at] = slack * np.quantile(np.concatenate(cosines), 0.01) if cosines else 0
    return np.maximum.accumulate(out)


@dataclass(frozen=True)
class LanguageModel:
    """Of bounded size: a vector of DIMS floats for each of the k centroids of each language."""

    idf: np.ndarray
    langs: tuple[str, ...]
    centroids: np.ndarray
    floors: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and whether it is rejected, of each text."""
        lettered = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)
        if not self.langs or not len(texts):
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        clean = cleaned(texts)
        sims = vectors_of(clean, self.idf) @ self.centroids.T
        best = np.argmax(sims, axis=1)
        length = np.maximum(np.searchsorted(LENGTHS, [letters_of(t) for t in clean], side="right") - 1, 0)
        score = np.where(lettered, np.clip(sims[np.arange(len(texts)), best], 0, 1), 0).astype(np.float64)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], score, ~lettered | (score < self.floors[best, length])


def fit(train: DataFrame, clusters: int = 4, sample_per_lang: int = 256, slack: float = 0.65) -> LanguageModel:
    """Learns from ``train(doc_id, text, lang)``.

    The idf is summed over all rows by task and dimension; only the k-means sees a sample, of at most
    ``sample_per_lang`` documents a language, whose members are found from doc_id and lang alone. A
    language rejects what has less than ``slack`` times the 1% quantile of its sample's cosines at that length.
    """
    spark = train.sparkSession
    train = columns_of(train, "doc_id", "text", "lang").where("lang is not null and text is not null and doc_id is not null")
    hashed = train.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    # First within 64 parts of each language, then among what these leave: a frequent language is never ranked by one task.
    near = hashed.selectExpr("doc_id", "lang", "h", "row_number() over (partition by lang, pmod(doc_id, 64) order by h, doc_id) as k").where(F.col("k") <= sample_per_lang)
    ranked = near.selectExpr("doc_id as id", "lang as l", "row_number() over (partition by lang order by h, doc_id) as k")
    chosen = ranked.where(F.col("k") <= sample_per_lang).select("id", "l").distinct()

    def frequencies(batches):
        import pyarrow as pa

        total, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for at in range(0, len(texts), 256):
                total += (counts_of(cleaned(texts[at : at + 256])) > 0).sum(axis=0)
            n += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tolist()], pa.list_(pa.int64()))], names=["n", "df"])

    found = train.select("text").mapInArrow(frequencies, "n long, df array<long>").select(F.posexplode("df").alias("dim", "df"), "n").groupBy("dim").agg(F.sum("df").alias("df"), F.sum("n").alias("n")).toPandas()
    df = np.zeros(DIMS)
    df[found["dim"]] = found["df"]
    n = int(found["n"].max()) if len(found) else 0
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    shared = spark.sparkContext.broadcast(idf)
    sample = train.join(F.broadcast(chosen), (train["doc_id"] == chosen["id"]) & (train["lang"] == chosen["l"]), "left_semi")
    # One row for each sampled doc_id and language, so that an id of very many rows is no more than one of the sample.
    sample = sample.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def sparse(texts: list[str | None]) -> list:
        clean = cleaned(texts)
        v = vectors_of(clean, shared.value)
        at = [np.flatnonzero(r) for r in v]
        return [[a.tolist() for a in at], [r[a].tolist() for r, a in zip(v, at, strict=True)], [t[:HEAD] for t in clean]]

    def centroids(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((len(pdf), DIMS), np.float32)
        for row, (at, w) in enumerate(zip(pdf["at"], pdf["w"], strict=True)):
            x[row, np.asarray(at, np.int64)] = w
        heads = pdf["head"].to_numpy()[x.any(axis=1)]
        x = x[x.any(axis=1)]
        if not len(x):
            return pd.DataFrame({"lang": [], "c": [], "floor": []})
        order = np.lexsort(x[:, ::97].T)  # the same whatever the order of rows
        x, heads = x[order], heads[order].tolist()
        c = cluster(x, clusters)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "c": list(c), "floor": [floors_of(x, heads, shared.value, clusters, slack)] * len(c)})

    rows = map_texts(sample, sparse, "at array<int>, w array<float>, head string", keep=("lang",)).groupBy("lang").applyInPandas(centroids, "lang string, c array<float>, floor array<double>").toPandas().sort_values("lang", kind="stable")
    return LanguageModel(idf, tuple(rows["lang"]), np.stack(rows["c"].to_list()).astype(np.float32) if len(rows) else np.zeros((0, DIMS), np.float32), np.stack(rows["floor"].to_list()) if len(rows) else np.zeros((0, len(LENGTHS))))


def predict(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with lang_pred, score and rejected, in the scan's own tasks."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, lambda texts: list(shared.value.predict(texts)), "lang_pred string, score double, rejected boolean", keep=keep)


def language_query(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; learned from the documents that are not held out."""
    model = fit(docs.where(~held_out_col()))
    return predict(docs, model).select("doc_id", held_out_col().alias("held_out"), "lang_pred", "score", "rejected")


def drop_rejected(docs: DataFrame) -> DataFrame:
    """The documents whose language is not rejected, with all their columns."""
    names = docs.columns
    model = fit(docs.where(~held_out_col()))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    mark = "rejected_language"
    while mark in map(str.lower, names):
        mark += "_"
    marked = map_texts(docs, lambda texts: [shared.value.predict(texts)[2]], f"{mark} boolean", keep=tuple(names))
    return marked.where(~F.col(mark)).select(*(F.col(f"`{n}`") for n in names))
