"""Shards of nearly equal bytes by a minimax contiguous partition.

Rows with equal texts are one group and stay together. Groups are ordered by a hash of the text and cut into contiguous
shards: the smallest capacity that SHARDS shards can hold is found by a search that checks candidates greedily, then
the cuts are spread within that capacity. Groups lie in blocks of the hash's leading bits, about 8 * sqrt(groups) of
them. The driver holds the sums of all blocks and, for a cut, the groups of the one block that it falls in: both grow
with the square root of the input. A row's shard follows from its hash and the cuts alone, with no join.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm import common

SHARDS = 16
#: Capacities that are checked at once.
CANDIDATES = 64
#: Rows of a shard that get their slots in one task, about.
SLOT_ROWS = 50_000


class Groups:
    """Prefix sums over the ordered groups, exact where they are asked for."""

    def __init__(self, groups: DataFrame, sums: np.ndarray):
        self.groups, self.upto, self.known = groups, np.concatenate(([0], np.cumsum(sums))), {}
        self.total = int(self.upto[-1])

    def need(self, blocks: set[int]) -> None:
        blocks = [b for b in sorted(blocks) if b not in self.known]
        if blocks:
            found = self.groups.filter(F.col("block").isin(blocks)).select("block", "key", "weight").toPandas().sort_values(["block", "key"])
            for b, part in found.groupby("block"):
                self.known[int(b)] = (part["key"].to_numpy(), self.upto[b] + np.cumsum(part["weight"].to_numpy()))

    def around(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        """For each x from 0 to total: the last prefix sum at most x, the first at least x, a key from which on (itself left out) groups lie after the former."""
        x = np.clip(np.asarray(x, np.int64), 0, self.total)
        blocks = np.clip(np.searchsorted(self.upto, x, "right") - 1, 0, len(self.upto) - 2)
        self.need({int(b) for b in blocks if self.upto[b + 1] > self.upto[b]})
        low, high, keys = x.copy(), x.copy(), []
        for i, (b, v) in enumerate(zip(blocks.tolist(), x.tolist(), strict=True)):
            if b not in self.known:  # x is the total, at an empty last block
                keys.append((1 << 63) - 1)
                continue
            key, upto = self.known[b]
            k = int(np.searchsorted(upto, v, "right"))
            low[i] = upto[k - 1] if k else self.upto[b]
            high[i] = low[i] if low[i] == v else upto[k]
            keys.append(int(key[k - 1]) if k else max(int(key[0]) - 1, -1 << 63))
        return low, high, keys

    def held(self, capacities: np.ndarray, shards: int) -> np.ndarray:
        """How much each capacity holds when shards are filled greedily."""
        at = np.zeros(len(capacities), np.int64)
        for _ in range(shards):
            at = self.around(np.minimum(at + capacities, self.total))[0]
        return at


def cuts(groups: Groups, largest: int, shards: int) -> list[int]:
    """Prefix sums at which the shards end, the last left out; some may be equal, for empty shards."""
    low, high = max(-(-groups.total // shards), largest), None
    step = max(1, largest)
    while high is None:  # a capacity that surely holds all
        tried = low + step * np.arange(CANDIDATES)
        fit = np.flatnonzero(groups.held(tried, shards) >= groups.total)
        if len(fit):
            high, low = int(tried[fit[0]]), int(tried[fit[0] - 1]) + 1 if fit[0] else low
        else:
            low = int(tried[-1]) + 1
    while low < high:
        tried = np.unique(np.linspace(low, high, CANDIDATES + 1).astype(np.int64))
        fit = np.flatnonzero(groups.held(tried, shards) >= groups.total)[0]
        high, low = int(tried[fit]), int(tried[fit - 1]) + 1 if fit else low
    latest, need = high, []  # from the end: where each shard must have ended at least, for the rest to hold what follows
    at = groups.total
    for _ in range(shards - 1):
        at = int(groups.around([max(at - latest, 0)])[1][0])
        need.append(at)
    found, start = [], 0
    for k, least in zip(range(shards, 1, -1), reversed(need), strict=True):
        ideal = start + (groups.total - start) / k
        below, above, _ = (x[0] for x in groups.around([int(ideal)]))
        end = int(below if ideal - below <= above - ideal and below > start else above)
        end = min(max(end, least), int(groups.around([min(start + latest, groups.total)])[0][0]))
        found.append(end)
        start = end
    return found


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, shard, slot.

    Size is the text's UTF-8 bytes (null: none) plus 1. Rows with equal texts share a shard, null with empty ones. The
    largest shard is as small as any cut of the ordered groups allows; if one group is larger than its part, the
    others share the rest. Slots count from 0 in each shard without gaps, by hash bucket and identifier; repeated rows
    get slots of their own. An empty table gives an empty result. Other columns of docs are not read.
    """
    spark, text = docs.sparkSession, F.coalesce(F.col(text_col), F.lit(""))
    rows = common.stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.monotonically_increasing_id().alias("row"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
        ),
        "sized",
    )
    count = rows.count()
    bits = min(30, max(1, math.ceil(math.log2(8 * math.sqrt(count + 1)))))
    block = (F.shiftright("key", 64 - bits) + (1 << (bits - 1))).cast("int")
    groups = rows.groupBy("key").agg(F.sum("size").alias("weight")).withColumn("block", block)
    groups = common.stored(groups.repartitionByRange(common.partitions(spark), "block").sortWithinPartitions("block", "key"), "groups")
    sums, largest = np.zeros(1 << bits, np.int64), 0
    found = groups.groupBy("block").agg(F.sum("weight").alias("n"), F.max("weight").alias("largest")).toPandas()
    if len(found):
        sums[found["block"].to_numpy()], largest = found["n"].to_numpy(), int(found["largest"].max())
    prefix = Groups(groups, sums)
    ends = prefix.around(cuts(prefix, largest, shards))[2] if count else []
    number = sum(((F.col("key") > F.lit(k)).cast("int") for k in ends), F.lit(0))
    buckets = max(common.partitions(spark), math.ceil(count / SLOT_ROWS))
    placed = rows.withColumn("shard", number.cast("int")).withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    slot = F.col("offset") + F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "row")) - 1
    return placed.join(offsets, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", slot.cast("long").alias("slot"))
