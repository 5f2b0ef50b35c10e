"""Mixing sources to target weights by pivotal dependent rounding (operator 1, DataFrame functions only).

Every document of source s should be taken target(s) / size(s) times. The integral part is taken as it
is; the fractional part, weighed by the document's words, is rounded by the pivotal method: two
fractional documents meet, a random transfer of words between them leaves one of the two with none or
all of its words, and the other carries what remains. Expected copies and the words of a source are
kept by every transfer, so the words taken miss the target by less than one document. Transfers run
inside small buckets of a source, long documents first, so that what is left is mostly a short one; what
each bucket has left meets again one level up, until one fractional document per source remains, so a
hot source is spread over as many tasks as it has buckets.

Results depend only on (source, doc_id, size) and the seed, never on partitions or file layout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh

WORD = r"[^\x20\x09-\x0D]+"
FAN_IN = 48


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """(source, size) -> source, source_size, n, target; one row per source.

    Weights repeat ``cycle`` over the sources by code point, null last. Targets share the total by
    weight; none exceeds ``most`` times its source, the excess goes to the others by weight. Water
    filling in closed form: ordered by size / weight, a source is at its limit while the level that
    the rest would get still exceeds its own limit. The window runs over one row per source.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), ((F.row_number().over(order) - 1) % len(cycle) + 1).cast("int"))
    by = by.withColumn("w", weight).withColumn("limit", F.lit(most) * F.col("source_size"))
    whole = Window.partitionBy(F.lit(0))
    rising = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    by = (
        by.withColumn("total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("w_left", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(rising), F.lit(0.0)))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("limit").over(rising), F.lit(0.0)))
    )
    # the levels left / w_left fall as long as sources are at their limits; the last level counts
    full = F.col("left") * F.col("w") >= F.col("limit") * F.col("w_left")
    by = by.withColumn("full", full)
    level = F.min(F.when(~F.col("full"), F.struct(F.col("limit") / F.col("w"), F.col("left") / F.col("w_left")))).over(whole)
    by = by.withColumn("level", level.getField("col2"))
    target = F.when(F.col("full"), F.col("limit")).otherwise(F.least(F.col("level") * F.col("w"), F.col("limit")))
    return by.select("source", "source_size", "n", F.coalesce(target, F.lit(0.0)).alias("target"))


def _uniform(*parts: Column | int) -> Column:
    """A number in [0, 1) from a hash of ``parts``."""
    bits = F.shiftrightunsigned(F.xxhash64(*[F.lit(p) if isinstance(p, int) else p for p in parts]), 11)
    return bits.cast("double") / F.lit(float(1 << 53))


def _pivot(items: Column, seed: int) -> Column:
    """Fold an ordered array of (small, h, id, size, base, n, mass) into done: [(id, size, n, copies)] and left."""
    item = "struct<small:bigint,h:bigint,doc_id:bigint,size:bigint,base:bigint,n:bigint,mass:double>"
    done = "struct<doc_id:bigint,size:bigint,n:bigint,copies:bigint>"

    def out(x: Column, up: Column | bool) -> Column:
        up = F.lit(up) if isinstance(up, bool) else up
        return F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["n"].alias("n"), (x["base"] + up.cast("bigint")).alias("copies"))

    def with_mass(x: Column, mass: Column) -> Column:
        return x.withField("mass", mass)

    def meet(acc: Column, e: Column) -> Column:
        c = acc["left"]
        to_c = F.least(c["size"] - c["mass"], e["mass"])  # words that may move from e to c
        to_e = F.least(c["mass"], e["size"] - e["mass"])
        u = _uniform(c["h"], e["h"], seed)
        first = (to_c + to_e == 0) | (u * (to_c + to_e) < to_e)
        fills_c, fills_e = c["size"] - c["mass"] <= e["mass"], e["size"] - e["mass"] <= c["mass"]
        both = c["mass"] + e["mass"]
        settled = F.when(first & fills_c, out(c, True)).when(first, out(e, False)).when(fills_e, out(e, True)).otherwise(out(c, False))
        left = (
            F.when(first & fills_c, with_mass(e, both - c["size"]))
            .when(first, with_mass(c, both))
            .when(fills_e, with_mass(c, both - e["size"]))
            .otherwise(with_mass(e, both))
        )
        return F.when(c.isNull(), F.struct(acc["done"].alias("done"), e.alias("left"))).otherwise(
            F.struct(F.concat(acc["done"], F.array(settled)).alias("done"), left.alias("left"))
        )

    zero = F.struct(F.array().cast(f"array<{done}>").alias("done"), F.lit(None).cast(item).alias("left"))
    return F.aggregate(items, zero, meet)


def mix_sizes(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: float = 3.0, seed: int = 7) -> DataFrame:
    """(doc_id, source, size) rows -> the same rows with source_size, target, copies, taken.

    Equal rows (same id, source and size) are one item with a multiplicity and share its copies as
    evenly as whole numbers allow. Documents without words get no copies. Empty input gives no rows.
    """
    items = cut(sizes.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("n")))
    by = cut(source_targets(items.select("source", (F.col("size") * F.col("n")).alias("size")), cycle, most))
    rows = items.join(by.withColumnRenamed("n", "n_source").withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    want = F.when(F.col("source_size") > 0, F.col("n") * F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("want", F.when(F.col("size") > 0, want).otherwise(0.0)).withColumn("base", F.floor("want"))
    rows = rows.withColumn("mass", (F.col("want") - F.col("base")) * F.col("size"))
    keep = ["source", "source_size", "target"]
    settled = rows.where("mass <= 0").select(*keep, "doc_id", "size", "n", F.col("base").alias("copies"))
    left = rows.where("mass > 0").select(
        *keep, F.ceil(F.col("n_source") / FAN_IN).alias("width"),
        F.struct((-F.col("size")).alias("small"), F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), "size", F.lit(seed)).alias("h"), "doc_id", "size", "base", "n", "mass").alias("item"),
    )
    widest = by.agg(F.max("n")).first()[0] or 0
    level = 0
    while True:
        width = -(-widest // FAN_IN)
        bucket = F.pmod(F.xxhash64("item.h", "item.doc_id", F.lit(seed + 1 + level)), F.greatest("width", F.lit(1)))
        met = cut(
            left.groupBy(*keep, "width", bucket.alias("bucket")).agg(F.sort_array(F.collect_list("item")).alias("items"))
            .select(*keep, "width", _pivot(F.col("items"), seed).alias("x"))
        )
        settled = settled.unionByName(met.select(*keep, F.explode("x.done").alias("d")).select(*keep, "d.*"))
        left = met.where("x.left is not null").select(*keep, F.ceil(F.col("width") / FAN_IN).alias("width"), F.col("x.left").alias("item"))
        widest, level = width, level + 1
        if width <= 1:
            break
    last = left.select(
        *keep, "item.doc_id", "item.size", "item.n",
        (F.col("item.base") + (_uniform(F.col("item.h"), seed + 99) * F.col("item.size") < F.col("item.mass")).cast("long")).alias("copies"),
    )
    settled = settled.unionByName(last).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    copies = F.floor(F.col("copies") / F.col("n")) + (F.col("k") <= F.col("copies") % F.col("n")).cast("long")
    return settled.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))


def mix_documents(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: float = 3.0, seed: int = 7) -> DataFrame:
    """Documents that the mix takes: their own columns and mix_size, mix_target, mix_copies, mix_taken.

    mix_copies (1 to ``most``) says how often the document is repeated; documents of no words or no
    copies are not taken. Rows that share source, doc_id and size share the copies of their item.
    """
    rows = docs.select(F.struct("*").alias("own"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    plan = mix_sizes(rows.select("doc_id", "source", "size"), cycle, most, seed)
    plan = plan.groupBy("doc_id", "source", "size", "source_size", "target").agg(F.sort_array(F.collect_list("copies"), asc=False).alias("all_copies"))
    plan = plan.where("all_copies[0] > 0").select(F.col("doc_id").alias("i"), F.col("source").alias("s"), F.col("size").alias("z"), "target", "all_copies")
    got = rows.join(plan, F.col("doc_id").eqNullSafe(F.col("i")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    single = got.where("size(all_copies) = 1").withColumn("copies", F.col("all_copies")[0])
    order = Window.partitionBy("doc_id", "source", "size").orderBy(F.xxhash64("own.text"))
    several = got.where("size(all_copies) > 1").withColumn("copies", F.get("all_copies", F.row_number().over(order) - 1))
    names = {c: fresh(docs.columns, c) for c in ("mix_size", "mix_target", "mix_copies", "mix_taken")}
    return single.unionByName(several).where("copies > 0").select(
        "own.*", F.col("size").alias(names["mix_size"]), F.col("target").alias(names["mix_target"]),
        F.col("copies").alias(names["mix_copies"]), (F.col("copies") * F.col("size")).alias(names["mix_taken"]),
    )
