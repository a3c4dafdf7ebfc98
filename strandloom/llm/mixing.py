"""Mixing sources to target weights by hash thresholds.

Each document has a 60-bit hash of its identifier. A source whose target is r times its size takes every document
floor(r) times and once more those whose hash is below the source's threshold. The threshold is found in histograms of
size by source and the hash's next DIGIT bits: the bucket in which the budget ends is refined by the next bits, reading
only its documents, until it holds one hash. Nothing is sorted, and thresholds for smaller budgets are nested in
those for larger ones, so a document that a smaller mix takes is taken by a larger one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm import common
from strandloom.operators.graph import numbered

#: Bits by which a histogram splits the hash, and the hash's bits.
DIGIT, BITS = 12, 60
#: Sources take these weights in turn.
WEIGHTS = (1, 2, 3)
#: The most times that a document is taken.
REPEATS = 3
#: Up to as many sources are joined by broadcast (a row is about 100 bytes); of more, only those with many rows (see common.join_counted).
BROADCAST_SOURCES = 20_000


def source_key(source: F.Column) -> F.Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit(""))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """sizes (key, source, source_size, n) with target, sources in order of code points, null last.

    All of the sizes are shared by weight; a source whose share is above repeats times its size gets just that, and the others
    share what is left. Each round of sharing raises the share of a unit of weight, so that only its value goes on, not the sources.
    """
    ordered = sizes.withColumn("place", F.when(F.col("key") == "", F.lit("1")).otherwise(F.concat(F.lit("0"), F.substring("key", 2, 2**31 - 1))))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("nth") - 1) % len(weights) + 1).cast("int"))
    given = common.stored(numbered(ordered, "place", "nth").withColumn("weight", weight), "weights")
    most = F.lit(repeats) * F.col("source_size")
    left, all_, above = (given.agg(F.sum("source_size").alias("left"), F.sum("weight").alias("all")).first()) + (0,)
    total, whole = left or 0, all_ or 1
    left, all_ = total, whole
    while True:
        over = most < F.lit(float(left)) * F.col("weight") / F.lit(all_)
        cut = given.filter(over).agg(F.count(F.lit(1)).alias("n"), F.sum(most).alias("most"), F.sum("weight").alias("weight")).first()
        if cut.n == above or cut.weight == whole:
            return given.withColumn("target", F.when(over, most.cast("double")).otherwise(F.lit(float(left)) * F.col("weight") / F.lit(all_))).drop("place", "nth", "weight")
        left, all_, above = total - cut.most, whole - cut.weight, cut.n


def hashed(id_col: str) -> F.Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit("mix"), F.col(id_col)), 64 - BITS)


def planned(rows: DataFrame, plan: DataFrame, key: str, n: str, count: int) -> DataFrame:
    """rows with their source's row of the plan; no source's rows meet in one task."""
    if plan.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(plan), key)
    return common.join_counted(rows, plan, key, n, count)


def thresholds(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame, int]:
    """The plan, a row per source (key, source_size, n, target, whole, below), the table of sizes that it was made from (doc_id, source, key, size, hash) and its number of rows."""
    digit = lambda level: F.shiftright("hash", BITS - DIGIT * (level + 1)).bitwiseAND(F.lit((1 << DIGIT) - 1))
    rows = common.stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            source_key(F.col(source_col)).alias("key"),
            common.n_words(F.col(text_col)).alias("size"),
            hashed(id_col).alias("hash"),
        ),
        "sizes",
    )
    sizes = common.stored(rows.groupBy("key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "sources")
    count = rows.count()
    size = F.col("source_size")
    whole = F.when(size > 0, F.least(F.floor(F.col("target") / size), F.lit(REPEATS))).otherwise(0).cast("int")
    state = targets(sizes).withColumn("whole", whole).withColumn("need", F.col("target") - F.col("whole") * size)
    state = common.stored(state.withColumn("below", F.lit(0).cast("long")).withColumn("open", F.col("need") > 0), "state")
    for level in range(BITS // DIGIT):
        open_ = state.filter("open").select("key", "n", F.shiftright("below", BITS - DIGIT * level).alias("prefix"), "need")
        if open_.isEmpty():
            break
        inside = planned(rows, open_, "key", "n", count).filter(F.shiftright("hash", BITS - DIGIT * level) == F.col("prefix"))
        by = inside.groupBy("key", digit(level).alias("digit")).agg(F.sum("size").alias("in"), F.min("hash").alias("lo"), F.max("hash").alias("hi"), F.first("need").alias("budget"))
        upto = Window.partitionBy("key").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        ends = by.withColumn("upto", F.sum("in").over(upto)).filter("upto > budget").groupBy("key").agg(F.min(F.struct("digit", "in", "upto", "lo", "hi")).alias("end"))
        met, rest = F.col("end").isNotNull(), F.col("need") - (F.col("end.upto") - F.col("end.in"))
        one = F.col("end.lo") == F.col("end.hi")
        below = F.when(one, F.col("end.lo") + (rest * 2 >= F.col("end.in")).cast("int")).otherwise(F.col("below").bitwiseOR(F.shiftleft("end.digit", BITS - DIGIT * (level + 1))))
        was = F.col("open")
        state, before = (
            common.stored(
                state.join(ends, "key", "left").select(
                    "key", "source_size", "n", "target", "whole",
                    F.when(was & met, rest).otherwise(F.col("need")).alias("need"),
                    F.when(was & met, below).when(was, F.lit(1 << BITS)).otherwise(F.col("below")).alias("below"),  # no end, by rounding: all of it
                    (was & met & ~F.coalesce(one, F.lit(False)) & (rest > 0)).alias("open"),
                ),
                "state",
            ),
            state,
        )
        common.forget(before)
    return state.select("key", "source_size", "n", "target", "whole", "below"), rows, count


def copies(hash_: F.Column) -> F.Column:
    """How often the plan takes a document."""
    return F.col("whole") + (hash_ < F.col("below")).cast("int")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken.

    Size is the number of words; null and empty texts have size 0, of which nothing is taken. A null source is a source of
    its own. Rows that repeat an identifier have one hash and are taken alike. The source that ends a budget inside
    rows of one hash takes all of them or none, whichever is nearer. Nothing but totals comes to the driver. An
    empty table gives an empty result. Other columns of docs are not read.
    """
    plan, rows, count = thresholds(docs, id_col, text_col, source_col)
    return planned(rows, plan, "key", "n", count).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * copies(F.col("hash"))).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with every row as often as the mix takes it, its columns unchanged, whatever their names; nulls, empty texts and repeated rows as in `mix`.

    Rows are not shuffled while there are up to BROADCAST_SOURCES sources. An empty table gives an empty result.
    """
    plan, _, count = thresholds(docs, id_col, text_col, source_col)
    key, n, whole, below, copy = common.fresh(docs, "key", "n", "whole", "below", "copy")
    plan = plan.select(F.col("key").alias(key), F.col("n").alias(n), F.col("whole").alias(whole), F.col("below").alias(below))
    times = F.col(whole) + (hashed(id_col) < F.col(below)).cast("int")
    joined = planned(docs.withColumn(key, source_key(F.col(source_col))), plan, key, n, count)
    return joined.select(*[F.col(c) for c in docs.columns], F.explode(F.array_repeat(F.lit(0), times)).alias(copy)).drop(copy)
