"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document; the ledger holds the measurements and one bit for each
failed rule. A policy is a versioned mask of rules that count, so a new policy, or the effect of leaving
one rule out, needs only the ledger and no text.

Defined results: a null text has no words; empty and wordless texts fail the least-words rule; a text
of one word, of one endless line or of many equal lines is measured whole; rows with equal or null
doc_id keep their own ledger rows; an empty table gives an empty ledger.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibron.llm.common import map_texts

#: Rule of each bit, lowest first, as an expression over the measurements.
RULES = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("short_or_long_words", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("capitals", "100 * n_capitals > 30 * word_chars"),
)
BASE_MASK = 0b000011
#: Rules that count, by version of the policy. Every version holds the base rules.
POLICIES = {"2026-01": BASE_MASK, "2026-02": 0b111111}
CURRENT = "2026-02"
SYMBOLS = b"#*$%&|<>"
CAPITALS = bytes(range(65, 91))
WINDOW = 8
MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_capitals long"


def _window_ids(ids: np.ndarray) -> np.ndarray:
    """Numbers of the 8-word windows, equal for equal windows only (doubling the width three times)."""
    width = 1
    while width < WINDOW:
        ids = np.unique(ids[:-width] * np.int64(len(ids) + 1) + ids[width:], return_inverse=True)[1]
        width *= 2
    return ids


def repeated_words(words: list[bytes]) -> int:
    """How many words stand in windows of 8 words that the text holds twice or more."""
    n = len(words)
    if n <= WINDOW:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    key = np.zeros(n - WINDOW + 1, np.uint64)
    for j in range(WINDOW):
        key = key * np.uint64(0x9E3779B97F4A7C15) + h[j : n - WINDOW + 1 + j]
    key.sort()
    if not (key[1:] == key[:-1]).any():  # equal windows have equal keys
        return 0
    number: dict[bytes, int] = {}
    ids = _window_ids(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n))
    twice = np.flatnonzero(np.bincount(ids)[ids] > 1)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    spaces = len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r"))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (len(words), len(text or "") - spaces, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated_words(words), len(raw) - len(raw.translate(None, CAPITALS)))


def failure_bits() -> F.Column:
    bits = F.lit(0).cast("long")
    for k, (_, rule) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``failed``, the bits of the failed rules."""
    return map_texts(docs, lambda texts: list(zip(*map(measure, texts), strict=True)) or [[]] * 7, MEASURES).withColumn("failed", failure_bits())


def apply_policy(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a version of the policy."""
    return rows.withColumn("base_failed", F.col("failed").bitwiseAND(F.lit(BASE_MASK)) != 0).withColumn("kept", F.col("failed").bitwiseAND(F.lit(POLICIES[version] | BASE_MASK)) == 0)


def ablations(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of the policy: documents that fail it, and those that only it removes.

    One pass of bitwise sums over the ledger; a row for each rule.
    """
    mask = POLICIES[version] | BASE_MASK
    hit = F.col("failed").bitwiseAND(F.lit(mask))
    bits = [k for k in range(len(RULES)) if mask >> k & 1]
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.bit_or(hit).alias("any_bits"), *(F.count_if(hit.bitwiseAND(F.lit(1 << k)) != 0).alias(f"f{k}") for k in bits), *(F.count_if(hit == (1 << k)).alias(f"o{k}") for k in bits))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(RULES[k][0]).alias("rule"), F.col("n").alias("n_docs"), F.col(f"f{k}").alias("n_failed"), F.col(f"o{k}").alias("n_only")) for k in bits))).alias("r")).select("r.*")


def quality_query(docs: DataFrame) -> DataFrame:
    return apply_policy(ledger(docs))


QUALITY_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d),
win AS (SELECT doc_id, i, list_slice(ws, i, i + 7) AS win FROM w, unnest(range(1, len(ws) - 6)) AS u(i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS k FROM win) WHERE k > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, unnest(range(0, 8)) AS u(j) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup
       FROM (SELECT doc_id, unnest(ls) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines,
      coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
      length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals
      FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id)),
b AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
      + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
      + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 8 ELSE 0 END
      + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 16 ELSE 0 END
      + CASE WHEN 100 * n_capitals > 30 * word_chars THEN 32 ELSE 0 END)::BIGINT AS failed FROM m)
SELECT *, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept FROM b
"""
