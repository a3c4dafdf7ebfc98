"""Coverage of a graph by reads: k-mer index, hits, adjacency, the three sums, histograms."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.operators import kmers as K
from strandloom.operators.graph import both_strands
from strandloom.plans.tables import stored

#: Rows of a k-mer index that are broadcast at most.
BROADCAST_ROWS = 200_000


def kmer_index(nodes: DataFrame, k: int) -> DataFrame:
    """(kmer, node_id, pos, same, mlen): where each canonical k-mer of the nodes lies; same says whether the node has it in canonical form. Of several places the smallest counts."""
    given = nodes.select(F.col("node_id").alias("read_id"), "seq")
    place = lambda same: F.struct(F.col("read_id").alias("node_id"), F.col("offset").alias("pos"), same.alias("same")).alias("place")
    if k <= K.PACKED:
        found = K.packed_offsets(given, k).select(S.unpack(F.col("code"), k).alias("kmer"), place(F.col("same")))
    else:
        canon = S.canonical(F.col("kmer"))
        found = K.kmer_offsets(given, k).select(canon.alias("kmer"), place(canon == F.col("kmer")))
    first = found.groupBy("kmer").agg(F.min("place").alias("place"))
    return first.select("kmer", "place.*").join(nodes.select("node_id", S.marginal_length(F.col("seq"), k).alias("mlen")), "node_id")


def hits(reads: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(read_id, offset, node, pos, mlen): k-mers of reads found in the graph, as places on signed nodes.

    The index is written first; with up to BROADCAST_ROWS rows (of about 100 bytes) it is broadcast, and only hits are
    shuffled afterwards. Packed windows meet it in canonical form; for longer ones it is turned to both strands, so that reads'
    windows are joined as they are.
    """
    place = lambda ahead: (F.when(ahead, F.col("node_id")).otherwise(-F.col("node_id")).alias("node"), F.when(ahead, F.col("pos")).otherwise(F.col("mlen") - 1 - F.col("pos")).alias("pos"), F.col("mlen"))
    if k <= K.PACKED:
        both, windows, key = index.select(S.pack(F.col("kmer")).alias("code"), F.col("same").alias("own"), "node_id", "pos", "mlen"), K.packed_offsets(reads, k), "code"
    else:
        back = index.filter(S.revcomp(F.col("kmer")) != F.col("kmer"))
        both = index.select("kmer", *place(F.col("same"))).unionByName(back.select(S.revcomp(F.col("kmer")).alias("kmer"), *place(~F.col("same"))))
        windows, key = K.kmer_offsets(reads, k), "kmer"
    both = stored(both, "index")
    found = windows.join(F.broadcast(both) if both.count() <= BROADCAST_ROWS else both, key)
    return found.select("read_id", "offset", *(place(F.col("same") == F.col("own")) if key == "code" else ("node", "pos", "mlen")))


def node_sums(hit: DataFrame) -> DataFrame:
    """(node_id, cov): how many k-mers of reads lie on each node, without looking at their neighbours."""
    return hit.groupBy(F.abs("node").alias("node_id")).agg(F.count(F.lit(1)).cast("double").alias("cov"))


def steps(hit: DataFrame, arcs: DataFrame) -> DataFrame:
    """Hits with what came one base before: kind is `inside` (the next k-mer of the node), `arc` (over an arc), `gap` (no neighbour in the read) or `break`."""
    order = Window.partitionBy("read_id").orderBy("offset")
    before = hit.withColumn("prev", F.lag(F.struct("offset", "node", "pos", "mlen")).over(order))
    near = (F.col("offset") - F.col("prev.offset") == 1)
    inside = near & (F.col("node") == F.col("prev.node")) & (F.col("pos") - F.col("prev.pos") == 1)
    strands = both_strands(arcs).select(F.col("src").alias("s"), F.col("dst").alias("d"), F.lit(True).alias("joined"))
    met = before.join(strands, (F.col("prev.node") == F.col("s")) & (F.col("node") == F.col("d")), "left")
    crosses = near & F.col("joined") & (F.col("pos") == 0) & (F.col("prev.pos") == F.col("prev.mlen") - 1)
    kind = F.when(inside, "inside").when(crosses, "arc").when(near, "break").otherwise("gap")
    return met.select("read_id", "offset", "node", "pos", "mlen", F.col("prev.node").alias("prev_node"), F.col("prev.pos").alias("prev_pos"), kind.alias("kind"))


def cov_count(reads: DataFrame, nodes: DataFrame, arcs: DataFrame, k: int, use_qual: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Sums over all reads: (node_id, cov), (node_id, pos, n), (src, dst, cov) with zeros for arcs that no read crosses, and (node_id, pos, n) for the step after pos.

    With qualities (reads.qual) a node's and an arc's coverage adds the probability that all bases of the window are
    right; counts by position are never weighted. Places are on the forward strand. Steps are written once, for all sums.
    """
    step = stored(steps(hits(reads, kmer_index(nodes, k), k), arcs), "steps")
    weight, arc_weight = F.lit(1.0), F.lit(1.0)
    if use_qual:
        scores = reads.select("read_id", S.qual_scores(F.col("qual")).alias("scores"))
        step = step.join(scores, "read_id")
        enough = F.size("scores") > 0
        weight = F.when(enough, S.window_correct(F.col("scores"), F.col("offset"), F.lit(k))).otherwise(1.0)
        arc_weight = F.when(enough, S.window_correct(F.col("scores"), F.col("offset") - 1, F.lit(k + 1))).otherwise(1.0)
    step = step.withColumn("w", weight).withColumn("aw", arc_weight)
    place = F.when(F.col("node") > 0, F.col("pos")).otherwise(F.col("mlen") - 1 - F.col("pos"))
    by_node = step.groupBy(F.abs("node").alias("node_id")).agg(F.sum("w").alias("cov"))
    by_pos = step.groupBy(F.abs("node").alias("node_id"), place.alias("pos")).agg(F.count(F.lit(1)).alias("n"))
    crossed = step.filter("kind = 'arc'").select(S.edge(F.col("prev_node"), F.col("node")).alias("e"), "aw").groupBy("e").agg(F.sum("aw").alias("seen")).select("e.*", "seen")
    by_arc = arcs.select("src", "dst").join(crossed, ["src", "dst"], "left").select("src", "dst", F.coalesce("seen", F.lit(0.0)).alias("cov"))
    inside = F.when(F.col("node") > 0, F.col("pos") - 1).otherwise(F.col("mlen") - 1 - F.col("pos"))
    by_step = step.filter("kind = 'inside'").groupBy(F.abs("node").alias("node_id"), inside.alias("pos")).agg(F.count(F.lit(1)).alias("n"))
    return by_node, by_pos, by_arc, by_step


def annotate(reads: DataFrame, nodes: DataFrame, arcs: DataFrame, k: int, use_qual: bool = False) -> tuple[DataFrame, DataFrame]:
    """The graph with cov, counts and arc_counts from reads."""
    by_node, by_pos, by_arc, by_step = cov_count(reads, nodes, arcs, k, use_qual)
    dense = lambda df, name: df.groupBy("node_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "n"))).alias(name))
    joined = nodes.select("node_id", "seq").join(by_node, "node_id", "left").join(dense(by_pos, "c"), "node_id", "left").join(dense(by_step, "a"), "node_id", "left")
    filled = lambda m, n: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.element_at(m, i), F.lit(0)).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    mlen = S.marginal_length(F.col("seq"), k)
    return joined.select("node_id", "seq", F.coalesce("cov", F.lit(0.0)).alias("cov"), filled(F.col("c"), mlen).alias("counts"), filled(F.col("a"), mlen - 1).alias("arc_counts")), by_arc


def histogram(values: DataFrame, value: str = "avg") -> DataFrame:
    """(cov, n) with values rounded to the nearest whole number."""
    return values.groupBy(F.floor(F.col(value) + 0.5).cast("long").alias("cov")).agg(F.count(F.lit(1)).alias("n"))


def split_histogram(values: DataFrame, value: str = "avg", weight: str | None = None) -> DataFrame:
    """(cov, weight): each value's weight is split linearly between the two whole numbers around it."""
    v, w = F.col(value), F.col(weight) if weight else F.lit(1.0)
    low, part = F.floor(v), v - F.floor(v)
    both = values.select(F.explode(F.array(F.struct(low.cast("long").alias("cov"), (w * (1 - part)).alias("weight")), F.struct((low + 1).cast("long").alias("cov"), (w * part).alias("weight")))).alias("x"))
    return both.select("x.*").filter("weight > 0").groupBy("cov").agg(F.sum("weight").alias("weight"))


def error_cutoff(err_lambda: float, p: float) -> int:
    """The first coverage from the error mean on that the Poisson error model gives a probability under p."""
    at = math.ceil(err_lambda)
    while at < 10 * err_lambda and math.exp(at * math.log(err_lambda) - err_lambda - math.lgamma(at + 1)) >= p:
        at += 1
    return at


def initial_coverage(nodes: DataFrame, err_lambda: float = 1.0, p: float = 0.01, mlen: str = "mlen") -> DataFrame:
    """(coverage): the mean over nodes that are hardly errors; twice the error mean if there are none."""
    cutoff = error_cutoff(err_lambda, p)
    total = nodes.filter(F.col("cov") / F.col(mlen) >= cutoff).agg(F.sum("cov").alias("c"), F.sum(mlen).alias("m"))
    return total.select(F.coalesce(F.col("c") / F.col("m"), F.lit(2.0 * err_lambda)).alias("coverage"))
