"""Line deduplication by an exact set-similarity join (operator 6, DataFrame functions only).

A line is the set of its words, lower-cased; it goes when an earlier line (by doc_id, then place) has a
Jaccard similarity of ``LIKE`` or more, whether or not that line itself stays. Lines without words stay.

1. A line's words become 32-bit hashes in the scan itself; line text is never shuffled. Equal lines are one
   candidate, their first; every later equal line goes. Lines that differ but have equal sets meet in step 3.
2. Tokens are ordered by rarity, from counts over all distinct lines in ``BUCKETS`` hash buckets (an order is
   all that the prefix filter needs, so the counts have a fixed size however large the vocabulary).
3. The prefix (``head``) of every distinct line is exploded to (token, line, place in the set) rows. Tokens
   of at most ``CROWD`` lines are joined with themselves behind length, position and signature filters
   (signatures of lines of more than ``LONG`` words have twice the classes).
4. Tokens of more lines are crowded. Their lines first meet the earliest line of the token, which settles
   large groups of near copies in a number of pairs linear in the group; only lines that are still open
   meet all lines of the token whose length is near.
5. Pairs that pass are verified on whole sets.

Sets are kept in a table bucketed by line, so that verification moves candidate pairs only. Words are
compared by 32-bit hashes within a pair of lines and lines by 64-bit ones.
"""

from __future__ import annotations

import math
import uuid
from contextlib import suppress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh

LIKE = 0.8
BUCKETS = 1 << 19
HOT = 1_000
#: Lines of a token from which its lines are settled by a leader first, and crowded tokens that are broadcast at most (more are joined by shuffle).
CROWD, BROADCAST = 256, 100_000
#: Words from which a line's signature has 128 classes: in 64 classes unlike lines of so many words differ too little.
LONG = 90


def tokens(line: Column) -> Column:
    """Distinct 32-bit hashes of a line's words, lower-cased."""
    low = F.lower(line)
    for c in "\t\v\f\r":
        low = F.replace(low, F.lit(c), F.lit(" "))
    return F.array_distinct(F.transform(F.array_remove(F.split(low, " "), ""), lambda w: F.hash(w)))


def _rarity(sets: DataFrame) -> Column:
    """Array over ``BUCKETS`` buckets: rank, times 2^32, of each by the number of lines that have a token of it.

    It is a subquery's one row, of fixed size, and not a constant, whose text would stand in every description of the plan.
    """
    some = sets.select(F.explode("toks").alias("t")).groupBy(F.col("t").bitwiseAND(F.lit(BUCKETS - 1)).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    every = sets.sparkSession.range(BUCKETS).join(some, F.col("id") == F.col("b"), "left")
    # steps of a quarter octave, as only the order matters
    rank = F.coalesce(F.floor(4 * F.log2(F.col("n"))) + 1, F.lit(0)) * F.lit(1 << 32)
    part = every.groupBy(F.floor(F.col("id") / 1024).alias("part")).agg(F.sort_array(F.collect_list(F.struct("id", rank.alias("r")))).alias("rs"))
    parts = part.select("part", F.col("rs.r").alias("rs")).groupBy().agg(F.sort_array(F.collect_list(F.struct("part", "rs"))).alias("parts"))
    return cut(parts.select(F.flatten("parts.rs").alias("ranks"))).scalar()


def _head(toks: Column, n: Column, rank: Column, like: float) -> Column:
    """A set's rarest tokens, as many as any similar set must share one of; each is added to its rank."""

    def ranked(ranks: Column) -> Column:
        return F.transform(toks, lambda t: F.coalesce(F.get(ranks, t.bitwiseAND(F.lit(BUCKETS - 1))), F.lit(0).cast("long")) + t)

    # by a lambda's argument, so that the array is read from its subquery once a row
    values = F.get(F.transform(F.array(rank), ranked), F.lit(0))
    return F.slice(F.sort_array(values), F.lit(1), n - F.ceil(like * n - 1e-9).cast("int") + 1)


def _heads(sets: DataFrame, like: float) -> DataFrame:
    """Rows of a table of sets with their prefix instead of their tokens."""
    # a subquery may not be written inside a lambda function; the optimiser joins both projections, so that no row holds the array
    own = ("id", "doc_id", "th", "pos", "n", "s", "h")
    ranked = sets.select(*own, "toks", _rarity(sets).alias("ranks"))
    return ranked.select(*own, _head(F.col("toks"), F.col("n"), F.col("ranks"), like).alias("head"))


def _signature(toks: Column) -> Column:
    """Parities of the tokens in 64 classes: sets differ in at least as many tokens as their signatures in bits."""
    return F.aggregate(toks, F.lit(0).cast("long"), lambda s, t: s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), t)))


def _half(toks: Column) -> Column:
    """Signature of the half of a long line's tokens that bit 6 marks; with the whole one it tells the other half's. 0 for other lines."""
    return F.when(F.size(toks) > LONG, _signature(F.filter(toks, lambda t: t.bitwiseAND(F.lit(64)) != 0))).otherwise(F.lit(0).cast("long"))


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, th, pos, id, line): lines with words; th tells texts of one doc_id apart, id is the line's hash."""
    rows = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).select("doc_id", "th", "pos", F.xxhash64("line").alias("id"), "line")


def _place(*at: str) -> Column:
    return F.struct(F.col(at[0]).isNull().alias("none"), *(F.col(c) for c in at))


def _least_common(n: Column, m: Column, like: float) -> Column:
    """Fewest common tokens with which sets of n and m tokens are similar (not rounded)."""
    return (n + m) * (like / (1 + like)) - 1e-9


def _passes(like: float) -> Column:
    """Signature and length filters on (n1, s1, h1) and (n2, s2, h2)."""
    n, m = F.col("n1"), F.col("n2")
    whole, half = F.col("s1").bitwiseXOR(F.col("s2")), F.col("h1").bitwiseXOR(F.col("h2"))
    most = (n + m) * ((1 - like) / (1 + like)) + 1e-9
    halves = (F.least(n, m) <= LONG) | (F.bit_count(half) + F.bit_count(whole.bitwiseXOR(half)) <= most)
    return (F.bit_count(whole) <= most) & (F.least(n, m) >= like * F.greatest(n, m) - 1e-9) & halves


def _distinct(pairs: DataFrame) -> DataFrame:
    """Distinct (a, b), cut, so that what found them can be let go before their sets are moved."""
    return cut(pairs.repartition("a").distinct())


def _similar(pairs: DataFrame, sets: DataFrame, like: float) -> DataFrame:
    """Distinct (a, b) candidates -> distinct ids of the later line of each pair that is similar."""
    x = sets.select(F.col("id").alias("a"), F.col("toks").alias("ta"), _place("doc_id", "th", "pos").alias("pa"))
    y = sets.select(F.col("id").alias("b"), F.col("toks").alias("tb"), _place("doc_id", "th", "pos").alias("pb"))
    both = pairs.join(x, "a").join(y, "b")
    ok = F.size(F.array_intersect("ta", "tb")) >= _least_common(F.size("ta"), F.size("tb"), like)
    return both.where(ok).select(F.when(F.col("pa") > F.col("pb"), F.col("a")).otherwise(F.col("b")).alias("id")).distinct()


def removed_lines(docs: DataFrame, like: float = LIKE) -> DataFrame:
    """(doc_id, th, removed): sorted places of the lines that go, per (doc_id, xxhash64 of the text).

    Rows that are equal in doc_id and text are one document. A null id comes last in order; a null text
    has no lines, an empty one a line without words, which stays. Of lines that tie at ``like`` the earlier stays.
    """
    spark = docs.sparkSession
    lines = _lines(docs.select("doc_id", "text"))
    toks = lines.select("doc_id", "th", "pos", "id", tokens(F.col("line")).alias("toks"))
    first = toks.groupBy("id").agg(F.min(_place("doc_id", "th", "pos")).alias("p"), F.first("toks").alias("toks"), F.count(F.lit(1)).alias("copies"))
    sets = first.select("id", "p.doc_id", "p.th", "p.pos", "copies", F.size("toks").alias("n"), _signature(F.col("toks")).alias("s"), _half(F.col("toks")).alias("h"), "toks")
    mark = uuid.uuid4().hex
    width = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sets.write.format("parquet").option("compression", "zstd").bucketBy(width, "id").saveAsTable(f"line_sets_{mark}")
    try:
        sets = spark.table(f"line_sets_{mark}")
        _heads(sets, like).write.format("parquet").option("compression", "zstd").saveAsTable(f"line_heads_{mark}")
        return _places(sets, _later_sets(sets, spark.table(f"line_heads_{mark}"), like), lines.drop("line"))
    finally:
        for kind in ("sets", "heads"):
            with suppress(Exception):
                spark.sql(f"DROP TABLE IF EXISTS line_{kind}_{mark}")


def _meeting(left: DataFrame, right: DataFrame, on: list[str], like: float, once: Column) -> DataFrame:
    """Rows of ``left`` (a, n1, s1, h1, i1) and ``right`` (b, n2, s2, h2, i2) of equal token that pass all filters.

    The first common token of a similar pair stands, in either set, within what the least overlap leaves.
    """
    need = _least_common(F.col("n1"), F.col("n2"), like)
    return left.join(right, on).where(once & _passes(like) & (F.col("n1") - F.col("i1") >= need) & (F.col("n2") - F.col("i2") >= need))


def _renamed(rows: DataFrame, left: bool, *more: str | Column) -> DataFrame:
    """Rows (t, id, n, s, h, i) as one side of a join. All columns are renamed on either side, so that both have one shuffle."""
    names = ("a", "n1", "s1", "h1", "i1") if left else ("b", "n2", "s2", "h2", "i2")
    return rows.select("t", *(F.col(c).alias(x) for c, x in zip(("id", "n", "s", "h", "i"), names, strict=True)), *more)


def _later_sets(sets: DataFrame, heads: DataFrame, like: float) -> DataFrame:
    """Ids of the lines that have an earlier similar line."""
    rows = heads.select("id", "n", "s", "h", F.posexplode("head").alias("i", "t"))
    # a token of so many lines is in a bucket of as many
    least = (math.floor(4 * math.log2(CROWD)) + 1) * (1 << 32) - (1 << 31)
    crowded = cut(rows.where(F.col("t") >= least).groupBy("t").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > CROWD).select("t"))
    many = crowded.count()
    small = F.broadcast if many <= BROADCAST else (lambda df: df)
    quiet = rows.join(small(crowded), "t", "left_anti") if many else rows
    pairs = _meeting(_renamed(quiet, True), _renamed(quiet, False), ["t"], like, F.col("a") < F.col("b")).select("a", "b")
    pairs = _distinct(pairs)
    if not many:
        return cut(_similar(pairs, sets, like))

    loud = heads.select("id", "n", "s", "h", _place("doc_id", "th", "pos").alias("p"), F.posexplode("head").alias("i", "t")).join(small(crowded), "t")
    lead = cut(loud.groupBy("t").agg(F.min(F.struct("p", "id", "n", "s", "h")).alias("x")).select("t", F.col("x.id").alias("b"), F.col("x.n").alias("n2"), F.col("x.s").alias("s2"), F.col("x.h").alias("h2")))
    met = loud.select("t", F.col("id").alias("a"), F.col("n").alias("n1"), F.col("s").alias("s1"), F.col("h").alias("h1")).join(small(lead), "t").where((F.col("a") != F.col("b")) & _passes(like))
    settled = cut(_similar(_distinct(met.select("a", "b")), sets, like))

    # lengths of a similar pair are at most one step apart
    step = F.floor(F.log("n") / F.lit(-math.log(like))).cast("int")
    loud = loud.select("t", "id", "n", "s", "h", "i", step.alias("l"))
    probe = _renamed(loud.join(settled, "id", "left_anti"), True, F.explode(F.array(*(F.col("l") + k for k in (-1, 0, 1)))).alias("l"))
    again = _meeting(probe, _renamed(loud, False, "l"), ["t", "l"], like, F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return cut(settled.unionByName(_similar(_distinct(pairs.unionByName(again)), sets, like)).distinct())


def _places(sets: DataFrame, later: DataFrame, lines: DataFrame) -> DataFrame:
    """Places of the lines that go: those of later lines and of all copies but the first.

    Lines that have a ``HOT``th of all places or more are at most ``HOT`` lines; these are broadcast and
    the others joined by shuffle.
    """
    gone = sets.join(later.withColumn("gone", F.lit(True)), "id", "left").where("gone or copies > 1")
    gone = cut(gone.select("id", F.coalesce("gone", F.lit(False)).alias("gone"), F.struct("doc_id", "th", "pos").alias("first"), "copies"))
    total = sets.agg(F.sum("copies")).first()[0] or 0
    own = F.struct("doc_id", "th", "pos")
    hot = gone.where(F.col("copies") * HOT >= total).select("id", F.col("gone").alias("hot_gone"), F.col("first").alias("hot_first"))
    here = lines.join(F.broadcast(hot), "id", "left").withColumn("key", F.when(F.col("hot_gone").isNull(), F.col("id")).otherwise(F.xxhash64("doc_id", "th", "pos")))
    cold = gone.where(F.col("copies") * HOT < total).select(F.col("id").alias("key"), "gone", "first")
    hit = here.join(cold, "key", "left").select("doc_id", "th", "pos", F.coalesce("hot_gone", "gone").alias("gone"), F.coalesce("hot_first", "first").alias("first"))
    hit = hit.where(F.col("first").isNotNull() & (F.col("gone") | ~own.eqNullSafe(F.col("first"))))
    return cut(hit.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("pos")).alias("removed")))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (places from 0); one row per document row."""
    gone = removed_lines(docs).select(F.col("doc_id").alias("i"), F.col("th").alias("g"), "removed")
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"), F.col("text").isNotNull().alias("there"))
    out = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("g")), "left")
    return out.select("doc_id", F.when(F.col("there"), F.col("n_lines")).otherwise(0).alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def remove_lines(docs: DataFrame, like: float = LIKE) -> DataFrame:
    """``docs`` with later similar lines cut from the text; every row stays, its text possibly empty."""
    gone = removed_lines(docs, like).select(F.col("doc_id").alias("i"), F.col("th").alias("g"), "removed")
    own = docs.select(F.struct("*").alias("own"), F.col("doc_id").alias("d"), F.xxhash64("text").alias("th"), "text")
    got = own.join(gone, F.col("d").eqNullSafe(F.col("i")) & (F.col("th") == F.col("g")), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda line, k: ~F.array_contains("removed", k)), "\n")
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(kept)
    name = fresh(docs.columns, "cleaned")
    got = got.select("own.*", text.alias(name))
    return got.select(*(F.col(name).alias(c) if c == "text" else F.col(c) for c in docs.columns))
