"""Order MinHash fingerprints with DataFrame functions only.

A text's tokens are its words, long ones cut after 16 characters; two neighbouring tokens make a k-mer
(a text of one token is one k-mer). Equal k-mers get occurrence numbers in text order, (k-mer, number)
is hashed, the hashes lie on a ring that is cut into 64 bins, and every bin takes the two hashes that
follow its start, if need be from later bins. Put back into text order, the k-mers of these two are hashed
as a tuple: one 32-bit component of the fingerprint, which changes if the text's order changes and not only
if its k-mers do. So a short text also has pairs in all its bins; only a text of one k-mer has no order.

Everything up to the fingerprint is computed within the row, in time n log n. Likeness is the share of
equal components; two empty fingerprints are alike.

Defined results: a null text is empty; texts without words have the empty fingerprint (all zeros); equal
texts have equal fingerprints. The next document is that with the next larger doc_id (after the last the
first, which can be the document itself); of rows with equal doc_id the smallest text (for near_next: the
smallest signature) counts as the next document, and each row is answered. A null doc_id has no place in the order: it has no next document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibron.llm.common import columns_of, let, written

BINS, KEEP, K = 64, 2, 2
BIN_BITS = 6
TOKEN = r"[^\x20\x09-\x0D]{1,16}"
#: Lower bits of the packed values, which hold a place in the text.
PLACE_BITS = 28
PLACE = (1 << PLACE_BITS) - 1


def _upto(n) -> F.Column:
    """0 .. n-1, empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def _packed(hashed, place) -> F.Column:
    return hashed.bitwiseAND(F.lit(~PLACE).cast("long")).bitwiseOR(place.cast("long"))


def _runs(values, shift: int, body) -> F.Column:
    """``body(first, after, values)`` for each run of sorted values that agree above their ``shift`` lowest bits."""

    def of(v):
        starts = F.filter(_upto(F.size(v)), lambda i: (i == 0) | (F.shiftrightunsigned(F.get(v, i), shift) != F.shiftrightunsigned(F.get(v, i - 1), shift)))
        return let(starts, lambda s: F.transform(s, lambda first, r: body(first, F.coalesce(F.get(s, r + 1), F.size(v)), v)))

    return let(values, of)


def kmers(text) -> F.Column:
    """Hashes of the k-mers of a text, in text order."""

    def of(w):
        n = F.size(w)
        return F.when(n >= K, F.transform(_upto(n - (K - 1)), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(K))))).when(n > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))

    return let(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), of)


def signature(text) -> F.Column:
    """The 64 components (array<int>) in the order of the signed hash, all zero for a text without words."""

    def of(k):
        by_kmer = F.sort_array(F.transform(k, lambda h, i: _packed(h, i)))

        def numbered(first, after, v):
            return F.transform(F.sequence(first, after - 1), lambda i: _packed(F.xxhash64(F.shiftrightunsigned(F.get(v, i), PLACE_BITS), i - first), F.get(v, i).bitwiseAND(F.lit(PLACE).cast("long"))))

        by_hash = F.sort_array(F.flatten(_runs(by_kmer, PLACE_BITS, numbered)))

        def stretch(first, after, v):
            """The component of a bin with k-mers, once for it and once for each empty bin before it."""
            n = F.size(v)
            own = F.transform(_upto(F.least(F.lit(KEEP), n)), lambda j: F.get(v, (first + j) % n).bitwiseAND(F.lit(PLACE).cast("long")))
            tuple_hash = F.xxhash64(F.transform(F.sort_array(own), lambda p: F.get(k, p.cast("int"))))
            low = tuple_hash.bitwiseAND(F.lit(0x7FFFFFFF).cast("long")).cast("int")
            bins = F.shiftright(F.get(v, first), 64 - BIN_BITS) - F.coalesce(F.shiftright(F.get(v, first - 1), 64 - BIN_BITS), F.lit(-BINS // 2 - 1))
            return F.array_repeat(F.greatest(low, F.lit(1)), bins.cast("int"))

        filled = F.flatten(_runs(by_hash, 64 - BIN_BITS, stretch))
        return let(filled, lambda c: F.concat(c, F.array_repeat(F.coalesce(F.get(c, 0), F.lit(0)), F.lit(BINS) - F.size(c))))

    return let(kmers(text), of)


def likeness(a, b) -> F.Column:
    """Share of equal components, 1 if neither text has words."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x == y) & (x != 0)), lambda t: t))
    used = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != 0) | (y != 0)), lambda t: t))
    return F.when(used == 0, F.lit(1.0)).otherwise(equal / used)


def as_text(sig) -> F.Column:
    """A signature as 8 hex digits for each bin."""
    return F.array_join(F.transform(sig, lambda c: F.lpad(F.lower(F.hex(c)), 8, "0")), "")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint): the general operator."""
    return columns_of(docs, "doc_id", "text").select("doc_id", as_text(signature(F.coalesce("text", F.lit("")))).alias("fingerprint"))


def neighbours(ids: DataFrame) -> DataFrame:
    """(doc_id, prev_id, prev_chars) for the distinct non-null ids of ``ids(doc_id, n_chars)``, in a ring.

    Rows are dealt by ranges of doc_id; only the first and last row of every range meet in one window.
    """
    one = ids.where("doc_id is not null").groupBy("doc_id").agg(F.max("n_chars").alias("n_chars"))
    ranged = written(one.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "omh_ids")
    edges = ranged.groupBy("part").agg(F.max(F.struct("doc_id", "n_chars")).alias("last"))
    ring = Window.partitionBy().orderBy("part")
    before = edges.select(F.col("part").alias("p"), F.coalesce(F.lag("last").over(ring), F.last("last").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("last"))
    within = Window.partitionBy("part").orderBy("doc_id")
    rows = ranged.withColumn("prev", F.lag(F.struct("doc_id", "n_chars")).over(within)).join(before, F.col("part") == F.col("p"))
    prev = F.coalesce("prev", "last")
    return written(rows.select("doc_id", prev["doc_id"].alias("prev_id"), prev["n_chars"].alias("prev_chars")), "omh_ring")


def minhash_query(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Texts move once, by doc_id; beside them go the leading quarters that the edits need and, at the end,
    the signatures.
    """
    scanned = columns_of(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    ring = neighbours(scanned.select("doc_id", F.length("text").cast("long").alias("n_chars")))
    own = scanned.where("doc_id is not null").repartition("doc_id")  # both uses below read this one exchange
    heads = own.groupBy("doc_id").agg(F.min("text").alias("text")).join(ring, "doc_id").select(F.col("prev_id").alias("head_of"), F.expr("substring(text, 1, cast(prev_chars div 4 as int))").alias("head"))
    n = F.length("text")
    placed = own.join(heads, own["doc_id"] == heads["head_of"]).join(ring.select(F.col("doc_id").alias("ring_id"), "prev_id"), own["doc_id"] == F.col("ring_id")).select("doc_id", "prev_id", "text", F.expr("substring(head, 1, cast(length(text) div 4 as int))").alias("head"))
    alone = scanned.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("prev_id"), "text", F.lit("").alias("head"))
    joined = placed.unionByName(alone)
    edited = F.concat(F.expr("substring(text, 1, cast(length(text) - length(text) div 4 as int))"), "head")
    marked = joined.select("doc_id", "prev_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited")).select("doc_id", "prev_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), signature(F.col("text")).alias("sig"), signature(F.col("edited")).alias("edited_sig"))
    rows = written(marked, "omh_signatures")
    following = rows.where("prev_id is not null").select(F.col("prev_id").alias("before_id"), "sig").groupBy("before_id").agg(F.min("sig").alias("next_sig"))
    out = rows.drop("prev_id").join(following, rows["doc_id"] == following["before_id"], "left")
    return out.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("sig")).alias("fingerprint"), as_text(F.col("edited_sig")).alias("edited_fingerprint"), likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), F.when(F.col("next_sig").isNotNull(), likeness(F.col("sig"), F.col("next_sig"))).otherwise(F.lit(0.0)).alias("near_next"))
