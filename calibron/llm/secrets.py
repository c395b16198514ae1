"""Secrets in texts: base patterns, and multipart credentials linked by an interval join.

Base spans (assignments, access ids, hex strings) come from one scan of each text. Weak candidates
(short passwords, user and client ids, endpoints) say little alone; they are reported only where a
complementary part lies within the same scope, ``SCOPE`` characters around it: an identifier needs a
secret, a weak secret an identifier or an endpoint, an endpoint a secret. Candidates of a text are
joined on the blocks of ``SCOPE`` characters that they touch, so a block meets its neighbours only.

All positions count code points, ends are exclusive. DataFrame functions only.

Defined results: a null text is empty and has no spans; texts of any length are searched whole, in the task
that scans them; a weak candidate that overlaps a base span is no candidate; rows with equal doc_id and text
(doc_id may be null) get equal results, repeated rows stay repeated; equal starts are ordered by kind;
further columns, whatever their names, are ignored by the query and kept by :func:`redacted`; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibron.llm.common import columns_of, let, written

#: Kinds in their order, with pattern, least length of the match and of its second group.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE = (("assign", ASSIGN, 0, 12), ("access", ACCESS, 18, 0), ("hex", HEX, 16, 0))
WEAK_ID = r"""(?i:\b(?:access_?key(?:_?id)?|client_?id|account|user(?:_?name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=@-]{3,})"""
WEAK_SECRET = r"""(?i:\b(?:password|passwd|pwd|pass|secret|token|api_?key|private_?key|auth)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=!@^~-]{4,})"""
ENDPOINT = r"""(?i:\b(?:https?|ftp|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D"'<>]{4,}|\b(?:endpoint|host(?:name)?|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:_-]{4,})"""
WEAK = (("weak_id", WEAK_ID), ("weak_secret", WEAK_SECRET), ("endpoint", ENDPOINT))
KINDS = tuple(k for k, *_ in BASE) + tuple(k for k, _ in WEAK)
#: Parts that make up a credential: what a weak candidate needs beside it.
PART = {"assign": "secret", "hex": "secret", "access": "id", "weak_id": "id", "weak_secret": "secret", "endpoint": "endpoint"}
NEEDS = {"weak_id": ("secret",), "weak_secret": ("id", "endpoint"), "endpoint": ("secret",)}
SCOPE = 200
STEP = 256


def _before(lengths) -> F.Column:
    """For each element the sum of those before it: sums of steps of 256 first, then within a step."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def of(v):
        steps = F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / STEP).cast("int")), lambda b: total(F.slice(v, b * STEP + 1, STEP)))
        return let(steps, lambda b: F.transform(v, lambda _, i: total(F.slice(b, 1, F.floor(i / STEP).cast("int"))) + total(F.slice(v, F.floor(i / STEP).cast("int") * STEP + 1, i % STEP))))

    return let(lengths, of)


def matches(text, pattern: str) -> F.Column:
    """Array of (start, end, match) of the leftmost non-overlapping matches: what split() leaves between
    the matches and the matches themselves give all positions."""

    def of(found):
        between = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
        steps = F.zip_with(between, F.transform(found, lambda m: F.length(m)), lambda a, b: a + F.coalesce(b, F.lit(0)))

        def place(gaps):
            return let(_before(steps), lambda before: F.transform(found, lambda m, i: F.struct((F.get(before, i) + F.get(gaps, i)).cast("long").alias("start"), (F.get(before, i) + F.get(gaps, i) + F.length(m)).cast("long").alias("end"), m.alias("match"))))

        return F.when(F.size(found) > 0, let(between, place)).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,match:string>>"))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)


def _spans(found, kind: int) -> F.Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


NO_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def _where(test, value) -> F.Column:
    """``value`` where a cheap test says that the text may hold a match, else no spans."""
    return F.when(test, value).otherwise(F.array().cast(NO_SPANS))


def base_spans(text) -> F.Column:
    """All base spans (start, kind, end) sorted by start and kind."""
    assign = F.filter(matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 2)) >= 12)
    # A run of the class is matched as a whole or not at all, so the least length can stand in the pattern.
    access = matches(text, r"AKIA[A-Z0-9]{14,}")
    hexes = matches(text, r"[0-9a-f]{16,}")
    return F.array_sort(
        F.concat(
            _where(text.rlike(r"(?i:passw|secret|token|api_?key)"), _spans(assign, 0)),
            _where(text.contains("AKIA"), _spans(access, 1)),
            _where(text.rlike(r"[0-9a-f]{16}"), _spans(hexes, 2)),
        )
    )


def weak_spans(text, base) -> F.Column:
    """Candidates that overlap no base span."""
    found = F.concat(
        _where(text.rlike(r"(?i:key|client|account|user|login)"), _spans(matches(text, WEAK_ID), 3)),
        _where(text.rlike(r"(?i:pass|pwd|secret|token|key|auth)"), _spans(matches(text, WEAK_SECRET), 4)),
        _where(text.rlike(r"(?i:://|host|endpoint|server)"), _spans(matches(text, ENDPOINT), 5)),
    )
    return F.array_sort(F.filter(found, lambda w: ~F.exists(base, lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"]))))


def as_text(spans) -> F.Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def linked(candidates: DataFrame) -> DataFrame:
    """(key, doc_id, added): the weak spans of ``candidates(key, doc_id, base, weak)`` that a complementary part confirms."""
    part = F.get(F.array(*(F.lit(PART[k]) for k in KINDS)), F.col("s.kind"))
    # Of a text of many copies one is enough: equal keys stand for equal texts.
    one = candidates.where(F.size("weak") > 0).groupBy("key", "doc_id").agg(F.max("base").alias("base"), F.max("weak").alias("weak"))
    every = one.select("key", "doc_id", F.explode(F.concat("base", "weak")).alias("s")).select("key", "doc_id", "s", part.alias("part"))
    needs = F.get(F.array(*(F.array(*(F.lit(p) for p in NEEDS.get(k, ()))).cast("array<string>") for k in KINDS)), F.col("s.kind"))
    block = lambda x: F.floor(x / SCOPE)
    asks = every.where("s.kind >= 3").select("key", "doc_id", "s", F.explode(needs).alias("part")).withColumn("block", F.explode(F.sequence(block(F.col("s.start") - SCOPE), block(F.col("s.end") + SCOPE))))
    gives = every.select("key", "doc_id", "part", F.col("s").alias("g")).withColumn("block", F.explode(F.sequence(block(F.col("g.start")), block(F.col("g.end")))))
    met = asks.alias("a").join(
        gives.alias("b"),
        F.expr(f"a.key = b.key and a.doc_id <=> b.doc_id and a.part = b.part and a.block = b.block and b.g.start <= a.s.end + {SCOPE} and a.s.start <= b.g.end + {SCOPE} and a.s <> b.g"),
        "left_semi",
    )
    return met.groupBy("key", "doc_id").agg(F.array_sort(F.collect_set("s")).alias("added"))


def scanned(docs: DataFrame) -> DataFrame:
    """``row``, a struct of all columns of ``docs``, with doc_id, base and weak, the spans of each text, and key, a hash of text and doc_id.

    As the columns of ``docs`` stand in one struct, none of them can clash with those of the scan.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    first = rows.select("row", F.col("row.doc_id").alias("doc_id"), F.xxhash64(text, F.col("row.doc_id")).alias("key"), base_spans(text).alias("base"))
    return first.withColumn("weak", weak_spans(text, F.col("base")))


def secrets_query(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans. The spans are written once, so that no text is searched twice."""
    rows = written(scanned(columns_of(docs, "doc_id", "text")).select("doc_id", "key", "base", "weak"), "secret_spans")
    added = linked(rows).select(F.col("key").alias("k"), F.col("doc_id").alias("d"), "added")
    out = rows.join(added, (rows["key"] == added["k"]) & rows["doc_id"].eqNullSafe(added["d"]), "left")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    every = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(NO_SPANS))))
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(as_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), as_text(every).alias("spans"))


#: Characters of a chunk of a text that is cut.
CHUNK = 256


def _between(text, starts, ends) -> F.Column:
    """The parts of a text from each start up to its end; each is taken from the chunks that hold it, so no part is searched for from the start of the text."""
    part = lambda chunks, a, b: F.substring(F.array_join(F.slice(chunks, (F.floor(a / CHUNK) + 1).cast("int"), (F.floor(b / CHUNK) - F.floor(a / CHUNK) + 1).cast("int")), ""), (a % CHUNK + 1).cast("int"), (b - a).cast("int"))
    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), lambda chunks: F.zip_with(starts, ends, lambda a, b: part(chunks, a, b)))


def _cut(text, spans) -> F.Column:
    """The text with every span replaced by [REDACTED]; overlapping spans become one.

    Spans are sorted by start. All of the first k have ended before the next one begins if, and only if, the
    k-th smallest end isn't behind its start; there one run of spans ends and another begins.
    """
    none = F.lit(None).cast("long")
    present = lambda a: F.filter(a, lambda x: x.isNotNull())

    def of(ends):
        heads = present(F.transform(spans, lambda s, i: F.when((i == 0) | (F.get(ends, i - 1) <= s["start"]), s["start"]).otherwise(none)))
        tails = present(F.transform(ends, lambda e, i: F.when((i == F.size(ends) - 1) | (e <= F.get(spans, i + 1)["start"]), e).otherwise(none)))
        starts = F.concat(F.array(F.lit(0).cast("long")), tails)
        stops = F.concat(heads, F.array(F.length(text).cast("long")))
        return F.array_join(_between(text, starts, stops), "[REDACTED]")

    return let(F.array_sort(F.transform(spans, lambda s: s["end"])), of)


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with every reported span replaced by [REDACTED] and n_chars counted anew; all other columns stay.

    The texts are searched once and written with their spans. Only the weak candidates move to be joined; the
    added spans come back by key and doc_id.
    """
    names = docs.columns
    rows = written(scanned(docs), "secret_rows")
    added = linked(rows.select("key", "doc_id", "base", "weak")).select(F.col("key").alias("k"), F.col("doc_id").alias("d"), "added")
    none = F.array().cast(NO_SPANS)
    # Most texts have no weak candidate and need no partner; only the others take part in the join.
    plain = rows.where(F.size("weak") == 0).select("row", F.col("base").alias("spans"))
    joined = rows.where(F.size("weak") > 0)
    joined = joined.join(added, (joined["key"] == added["k"]) & joined["doc_id"].eqNullSafe(added["d"]), "left").select("row", F.array_sort(F.concat("base", F.coalesce("added", none))).alias("spans"))
    text = F.col("row.text")
    cut = plain.unionByName(joined).select("row", F.size("spans").alias("found"), F.when(F.size("spans") > 0, _cut(text, F.col("spans"))).otherwise(text).alias("clean"))
    made = {"text": F.col("clean")}
    if "n_chars" in names:
        made["n_chars"] = F.when(F.col("found") > 0, F.length("clean").cast("long")).otherwise(F.col("row.n_chars"))
    return cut.select(*(made[c].alias(c) if c in made else F.col(f"row.`{c}`") for c in names))
