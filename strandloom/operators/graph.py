"""Bidirected graphs as two tables: nodes (node_id > 0, seq, cov, counts, arc_counts) and arcs (src, dst, cov).

A negative id is a node's reverse complement. An arc is stored once, in canonical form; `both_strands` adds its mirror
image. cov of a node is the sum over its k-mers, counts has one number for each k-mer and arc_counts one for each step
between neighbouring k-mers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.plans.tables import stored

#: Steps whose paths are followed to their end in one task, after rounds that leave no more.
ONE_TASK = 1_000_000


def both_strands(arcs: DataFrame) -> DataFrame:
    """Arcs and their mirror images; an arc that is its own image once."""
    return arcs.select(F.explode(F.array_distinct(F.array(F.struct("src", "dst", "cov"), F.struct((-F.col("dst")).alias("src"), (-F.col("src")).alias("dst"), "cov")))).alias("a")).select("a.*")


def canonical_arcs(pairs: DataFrame) -> DataFrame:
    """Each of pairs (src, dst, cov) in canonical form, covs of one edge added up."""
    return pairs.select(S.edge(F.col("src"), F.col("dst")).alias("e"), "cov").groupBy("e").agg(F.sum("cov").alias("cov")).select("e.src", "e.dst", "cov")


def oriented_nodes(nodes: DataFrame, k: int) -> DataFrame:
    """Nodes and their reverse complements, with mlen."""
    back = nodes.select((-F.col("node_id")).alias("node_id"), S.revcomp(F.col("seq")).alias("seq"), "cov", F.reverse("counts").alias("counts"), F.reverse("arc_counts").alias("arc_counts"))
    return nodes.select("node_id", "seq", "cov", "counts", "arc_counts").unionByName(back).withColumn("mlen", S.marginal_length(F.col("seq"), k))


def degrees(arcs: DataFrame) -> DataFrame:
    """(node, outdeg): arcs that leave each signed node; nodes without any are left out. The in-degree of n is the out-degree of -n."""
    return both_strands(arcs).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("outdeg"))


def sides(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """(node_id, n_left, n_right)."""
    out = degrees(arcs)
    found = out.groupBy(F.abs("node").alias("node_id")).agg(F.sum(F.when(F.col("node") < 0, F.col("outdeg")).otherwise(0)).alias("n_left"), F.sum(F.when(F.col("node") > 0, F.col("outdeg")).otherwise(0)).alias("n_right"))
    return nodes.select("node_id").join(found, "node_id", "left").na.fill(0, ["n_left", "n_right"])


def low_coverage_nodes(nodes: DataFrame, most: float, mlen: str = "mlen") -> DataFrame:
    """Nodes whose average coverage is at most a limit."""
    return nodes.filter(F.col("cov") / F.col(mlen) <= most)


def low_coverage_arcs(arcs: DataFrame, most: float) -> DataFrame:
    return arcs.filter(F.col("cov") <= most)


def tips(nodes: DataFrame, arcs: DataFrame, most: float, max_len: int = 0) -> DataFrame:
    """Nodes with no arcs on one side at least, up to a length (0: any) and an average coverage."""
    found = nodes.join(sides(nodes, arcs), "node_id").filter((F.col("n_left") == 0) | (F.col("n_right") == 0)).filter(F.col("cov") / F.col("mlen") <= most)
    return found.filter(F.col("mlen") <= max_len) if max_len else found


def bubbles(nodes: DataFrame, arcs: DataFrame, most: float, k: int) -> DataFrame:
    """Nodes of k k-mers with one arc on each side, up to an average coverage."""
    return nodes.join(sides(nodes, arcs), "node_id").filter("n_left = 1 AND n_right = 1").filter((F.col("mlen") == k) & (F.col("cov") / F.col("mlen") <= most))


def remove_nodes(nodes: DataFrame, arcs: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the nodes in gone (node_id) and the arcs at them."""
    left = nodes.join(gone, "node_id", "left_anti")
    for side in ("src", "dst"):
        arcs = arcs.withColumn("node_id", F.abs(side)).join(gone, "node_id", "left_anti").drop("node_id")
    return left, arcs


def remove_arcs(arcs: DataFrame, gone: DataFrame) -> DataFrame:
    """arcs without those in gone (src, dst), whichever strand it names."""
    e = gone.select(S.edge(F.col("src"), F.col("dst")).alias("e")).select("e.*").distinct()
    return arcs.withColumn("e", S.edge(F.col("src"), F.col("dst"))).join(e.select(F.struct("src", "dst").alias("e")), "e", "left_anti").drop("e")


def remove_coverage(nodes: DataFrame, arcs: DataFrame, cutoff: float, max_len: int) -> tuple[DataFrame, DataFrame]:
    """Without arcs of at most the cutoff, then without nodes whose average is at most the cutoff and whose length is at most max_len."""
    arcs = arcs.filter(F.col("cov") > cutoff)
    return remove_nodes(nodes, arcs, nodes.filter((F.col("cov") / F.size("counts") <= cutoff) & (F.size("counts") <= max_len)).select("node_id"))


def sample(df: DataFrame, n: int, *keys: str, seed: int = 0) -> DataFrame:
    """n rows, chosen by a hash of keys: the same for the same seed."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(x).cast("string") for x in keys]))).limit(n)


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """df with dense numbers from 1 in the order of a unique column, without gathering it in one task: rows are numbered in ranges whose sizes are added up first."""
    ranges = df.repartitionByRange(F.col(by)).withColumn("__part", F.spark_partition_id())
    ranges = stored(ranges, "ranges")
    before = ranges.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__part", "before")
    place = F.row_number().over(Window.partitionBy("__part").orderBy(by))
    return ranges.join(F.broadcast(before), "__part").withColumn(name, (F.col("before") + place).cast("int")).drop("__part", "before")


def followed(hit: DataFrame) -> DataFrame:
    """(node, head, dist, least) of rows (node, jump, dist, least, head, d, l), of which each has a head or its jump is another row's node; in one task."""
    names = ["node", "jump", "dist", "least", "head", "d", "l"]
    out = ["node", "head", "dist", "least"]

    def follow(batches):
        parts = [[batch.column(n).fill_null(0).to_numpy() for n in names] for batch in batches if len(batch)]
        if not parts:
            return
        node, jump, dist, least, head, d, least_on = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, done, own = np.argsort(node), head != 0, np.arange(len(node))
        at = np.where(done, own, order[np.minimum(np.searchsorted(node, jump, sorter=order), len(node) - 1)])
        if (node[at] != jump)[~done].any():
            raise ValueError("a step leads to no step")
        far, low = np.where(done, 0, dist), np.where(done, np.minimum(least, least_on), least)
        for _ in range(len(node).bit_length()):  # enough to go round every cycle
            if done[at].all():
                break
            far, low, at = far + far[at], np.minimum(low, low[at]), at[at]
        ends, low = done[at], np.minimum(low, low[at])
        far = np.where(ends, far + (dist + d)[at], 0)
        for i in range(0, len(node), 100_000):
            j = i + 100_000
            yield pa.RecordBatch.from_arrays([pa.array(node[i:j]), pa.array(head[at][i:j], mask=~ends[i:j]), pa.array(far[i:j]), pa.array(low[i:j])], out)

    found = hit.select([F.col(n).cast("long") for n in names]).repartition(1).mapInArrow(follow, "node long, head long, dist long, least long")
    return found.select([F.col(n).cast(hit.schema["dist" if n == "dist" else "node"].dataType) for n in out])


def reach(steps: DataFrame) -> DataFrame:
    """(node, head, dist, least): for steps (node, prev) in which every node has at most one prev, the first node of its path, its distance and the smallest absolute id on the way; on a cycle head is null and least that of the cycle. By pointer doubling: the number of rounds is the logarithm of the longest path, and the last ONE_TASK steps end in one task."""
    starts = steps.select(F.col("prev").alias("node")).join(steps.select("node"), "node", "left_anti").distinct()
    ends = stored(starts.select("node", F.col("node").alias("head"), F.lit(0).alias("dist"), F.abs("node").alias("least")), "ends")
    going = stored(steps.select("node", F.col("prev").alias("jump"), F.lit(1).alias("dist"), F.least(F.abs("node"), F.abs("prev")).alias("least")), "going")
    found, left, same = ends, going.count(), 0
    while left:
        hit = going.join(found.select(F.col("node").alias("jump"), "head", F.col("dist").alias("d"), F.col("least").alias("l")), "jump", "left")
        if left <= ONE_TASK:
            return found.unionByName(stored(followed(hit), "followed"))
        hit = stored(hit, "hit")
        found = stored(found.unionByName(hit.filter("head IS NOT NULL").select("node", "head", (F.col("dist") + F.col("d")).alias("dist"), F.least("least", "l").alias("least"))), "found")
        rest = hit.filter("head IS NULL").select("node", "jump", "dist", "least")
        going = stored(rest.join(going.select(F.col("node").alias("jump"), F.col("jump").alias("next"), F.col("dist").alias("d"), F.col("least").alias("l")), "jump").select("node", F.col("next").alias("jump"), F.least(F.col("dist").cast("long") + F.col("d"), F.lit((1 << 31) - 1)).cast("int").alias("dist"), F.least("least", "l").alias("least")), "going")  # only on a cycle it grows without end
        now = going.count()
        same = same + 1 if now == left else 0
        left = now
        if same and 2**same >= left:  # only cycles are left, and each has been gone round
            break
    return found.unionByName(going.select("node", F.lit(None).cast(found.schema["head"].dataType).alias("head"), "dist", "least"))


def chains(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """(node, head, rank): the maximal unbranched paths of the graph, each once, in the direction in which its node of smallest id is forward; single nodes are paths of one."""
    strands = stored(both_strands(arcs), "strands")
    out = strands.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    single = out.filter("n = 1").select("src")
    steps = strands.join(single, "src").join(single.select((-F.col("src")).alias("dst")), "dst").filter("abs(src) <> abs(dst)").select(F.col("dst").alias("node"), F.col("src").alias("prev"))
    steps = stored(steps, "steps")
    found = stored(reach(steps), "reach")
    cycles = found.filter("head IS NULL").select("node", "least")
    if not cycles.isEmpty():
        cut = steps.join(cycles, "node").filter("abs(node) <> least").select("node", "prev")  # a cycle starts at its smallest id
        found = stored(found.filter("head IS NOT NULL").unionByName(reach(cut)), "reach")
    ids = nodes.select(F.explode(F.array("node_id", -F.col("node_id"))).alias("node"))
    alone = ids.join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("head"), F.lit(0).alias("dist"))
    paths = stored(found.select("node", "head", "dist").unionByName(alone), "paths")
    keep = paths.groupBy("head").agg(F.min_by("node", F.abs("node")).alias("first")).filter("first > 0").select("head")
    return paths.join(keep, "head").select("node", "head", F.col("dist").alias("rank"))


def concatenate(nodes: DataFrame, arcs: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Nodes joined along unbranched paths, and the arcs that are left. Sequences overlap by k - 1 bases; counts are put side by side with the covs of the joining arcs between the arc counts; covs are added up. A path's new id follows its smallest old one."""
    path = stored(chains(nodes, arcs), "chains")
    strands = both_strands(arcs)
    joint = path.alias("a").join(path.alias("b"), (F.col("a.head") == F.col("b.head")) & (F.col("a.rank") == F.col("b.rank") + 1)).select(F.col("b.node").alias("src"), F.col("a.node").alias("dst"), F.col("a.node").alias("node"))
    joint = joint.join(strands, ["src", "dst"]).select("node", F.col("cov").alias("joint"))
    parts = path.join(oriented_nodes(nodes, k), path.node == F.col("node_id")).drop("node_id").join(joint, "node", "left")
    row = F.struct("rank", "node", "seq", "cov", "counts", "arc_counts", "joint")
    whole = parts.groupBy("head").agg(F.sort_array(F.collect_list(row)).alias("p"), F.min(F.abs("node")).alias("least"))
    whole = whole.select(
        "head",
        F.element_at("p", -1)["node"].alias("tail"),
        "least",
        S.glue(F.col("p.seq"), k).alias("seq"),
        F.aggregate("p", F.lit(0.0), lambda acc, x: acc + x["cov"]).alias("cov"),
        F.flatten("p.counts").alias("counts"),
        F.flatten(F.transform("p", lambda x: F.concat(F.when(x["rank"] > 0, F.array(x["joint"].cast("long"))).otherwise(F.array().cast("array<bigint>")), x["arc_counts"]))).alias("arc_counts"),
    )
    whole = stored(numbered(stored(whole, "whole"), "least", "node_id"), "joined")
    new = whole.select(F.explode(F.array(F.struct(F.col("tail").alias("src"), F.col("node_id").alias("id")), F.struct((-F.col("head")).alias("src"), (-F.col("node_id")).alias("id")))).alias("e")).select("e.*")
    outer = strands.join(new.withColumnRenamed("id", "new_src"), "src").join(new.select((-F.col("src")).alias("dst"), (-F.col("id")).alias("new_dst")), "dst")
    inner = path.select("head", F.col("node"), "rank")
    inner = inner.alias("a").join(inner.alias("b"), (F.col("a.head") == F.col("b.head")) & (F.col("a.rank") == F.col("b.rank") + 1)).select(F.col("b.node").alias("src"), F.col("a.node").alias("dst"))
    inner = inner.unionByName(inner.select((-F.col("dst")).alias("src"), (-F.col("src")).alias("dst")))
    left = outer.join(inner, ["src", "dst"], "left_anti").select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"), "cov")
    left = left.select(S.edge(F.col("src"), F.col("dst")).alias("e"), "cov").groupBy("e").agg(F.first("cov").alias("cov")).select("e.src", "e.dst", "cov")
    return whole.select("node_id", "seq", "cov", "counts", "arc_counts"), left


def defrag(nodes: DataFrame, arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dense new ids in the order of the old, in both tables."""
    new = stored(numbered(nodes.select("node_id"), "node_id", "new"), "defrag")
    for side in ("src", "dst"):
        arcs = arcs.join(new.select(F.col("node_id").alias("__id"), "new"), F.abs(side) == F.col("__id")).withColumn(side, F.signum(side).cast("int") * F.col("new")).drop("__id", "new")
    return nodes.join(new, "node_id").withColumn("node_id", F.col("new")).drop("new"), arcs


def neighbourhood(arcs: DataFrame, seeds: DataFrame, depth: int, directed: bool = False) -> DataFrame:
    """(seed, node_id, dist) up to a number of arcs away; directed: (seed, node, dist) with signed nodes, following arcs only. A node is reached once, at its least distance."""
    strands = both_strands(arcs)
    if directed:
        pairs, name = strands.select(F.col("src").alias("a"), F.col("dst").alias("b")), "node"
    else:
        pairs, name = strands.select(F.abs("src").alias("a"), F.abs("dst").alias("b")), "node_id"
    pairs = stored(pairs.distinct(), "pairs")
    found = seeds.select("seed", F.col("seed").alias(name), F.lit(0).alias("dist"))
    front = found
    for d in range(1, depth + 1):
        front = front.join(pairs, F.col(name) == F.col("a")).select("seed", F.col("b").alias(name), F.lit(d).alias("dist")).distinct().join(found, ["seed", name], "left_anti")
        front = stored(front, "front")
        found = found.unionByName(front)
    return found


def components(pairs: DataFrame) -> DataFrame:
    """(node, component): the smallest node connected to each, for pairs (a, b). Nodes take the smallest label of their neighbours, then of their label, until nothing changes."""
    edges = stored(pairs.select("a", "b").union(pairs.select("b", "a")).distinct(), "pairs")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        jump = step.join(labels.select(F.col("node").alias("next"), F.col("label").alias("far")), "next").select("node", "label", F.least("next", "far").alias("next"))
        jump = stored(jump, "jump")
        labels = jump.select("node", F.col("next").alias("label"))
        if jump.filter("label <> next").isEmpty():
            return labels.withColumnRenamed("label", "component")


def sanity(nodes: DataFrame, arcs: DataFrame, k: int) -> DataFrame:
    """(problem, n): arcs at missing nodes, arcs whose ends do not overlap by k - 1 bases, counts of the wrong number, arcs stored twice. No row means a sound graph."""
    ends = oriented_nodes(nodes, k).select("node_id", "seq")
    src, dst = ends.select(F.col("node_id").alias("src"), F.col("seq").alias("src_seq")), ends.select(F.col("node_id").alias("dst"), F.col("seq").alias("dst_seq"))
    joined = arcs.join(src, "src", "left").join(dst, "dst", "left")
    dead = joined.filter("src_seq IS NULL OR dst_seq IS NULL").select(F.lit("arc at a missing node").alias("problem"))
    apart = joined.filter(F.expr(f"right(src_seq, {k - 1}) <> left(dst_seq, {k - 1})")).select(F.lit("ends do not overlap").alias("problem"))
    wrong = nodes.filter((F.size("counts") != F.length("seq") - k + 1) | (F.size("arc_counts") != F.length("seq") - k)).select(F.lit("wrong number of counts").alias("problem"))
    twice = canonical_arcs(arcs.withColumn("cov", F.lit(1.0))).filter("cov > 1").select(F.lit("arc stored twice").alias("problem"))
    return dead.unionByName(apart).unionByName(wrong).unionByName(twice).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def within(nodes: DataFrame, arcs: DataFrame, source: int, most: int, max_rounds: int = 1000) -> DataFrame:
    """(node, dist): signed nodes whose least distance from the end of a source, in bases added, is at most a number. Distances are relaxed in rounds of joins."""
    add = nodes.select(F.explode(F.array("node_id", -F.col("node_id"))).alias("dst"), F.size("counts").alias("w"))
    steps = stored(both_strands(arcs).join(add, "dst").select("src", "dst", "w"), "steps")
    found = stored(nodes.sparkSession.createDataFrame([(source, 0)], "node int, dist int"), "within")
    for _ in range(max_rounds):
        more = found.join(steps, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("dist") + F.col("w")).alias("dist")).filter(F.col("dist") <= most)
        new = stored(found.unionByName(more).groupBy("node").agg(F.min("dist").alias("dist")), "within")
        if new.exceptAll(found).isEmpty():
            return new
        found = new
    return found


def between(nodes: DataFrame, arcs: DataFrame, source: int, target: int, most: int) -> DataFrame:
    """(node): signed nodes for which the bases added from a source to them and from a target back to them are at most a number together."""
    ahead = within(nodes, arcs, source, most)
    back = within(nodes, arcs, -target, most).select((-F.col("node")).alias("node"), F.col("dist").alias("rest"))
    return ahead.join(back, "node").filter(F.col("dist") + F.col("rest") <= most).select("node")


def present(moves: DataFrame, ids: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node_id, now): where nodes are after a chain of moves (node_id, to)."""
    found = ids.select("node_id", F.col("node_id").alias("now"))
    for _ in range(max_rounds):
        step = stored(found.join(moves.select(F.col("node_id").alias("now"), "to"), "now", "left").select("node_id", "now", "to"), "present")
        found = step.select("node_id", F.coalesce("to", "now").alias("now"))
        if step.filter("to IS NOT NULL").isEmpty():
            break
    return found
