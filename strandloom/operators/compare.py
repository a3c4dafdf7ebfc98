"""A graph against known sequences: segments, breaks, node chains, true multiplicities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import sequence as S


def islands(steps: DataFrame) -> DataFrame:
    """steps (operators.coverage.steps) with seg_no, which grows at every step that does not follow the one before."""
    order = Window.partitionBy("read_id").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("seg_no", F.sum(F.col("kind").isin("gap", "break").cast("int")).over(order))


def segments(steps: DataFrame, k: int) -> DataFrame:
    """(read_id, seg_no, type, seq_begin, seq_end, src_node, src_pos, dst_node, dst_pos): CONTIG for stretches that the graph spells, BREAK for what lies between two of them. seq_end is the first base after."""
    first, last = F.min(F.struct("offset", "node", "pos")), F.max(F.struct("offset", "node", "pos"))
    contig = islands(steps).groupBy("read_id", "seg_no").agg(first.alias("a"), last.alias("b"))
    after = F.lead(F.struct("a", "b")).over(Window.partitionBy("read_id").orderBy("seg_no"))
    contig = contig.withColumn("next", after)
    own = contig.select("read_id", (2 * F.col("seg_no") - 1).alias("seg_no"), F.lit("CONTIG").alias("type"), F.col("a.offset").alias("seq_begin"), (F.col("b.offset") + k).alias("seq_end"), F.col("a.node").alias("src_node"), F.col("a.pos").alias("src_pos"), F.col("b.node").alias("dst_node"), F.col("b.pos").alias("dst_pos"))
    gaps = contig.filter("next IS NOT NULL").select("read_id", (2 * F.col("seg_no")).alias("seg_no"), F.lit("BREAK").alias("type"), (F.col("b.offset") + k).alias("seq_begin"), F.col("next.a.offset").alias("seq_end"), F.col("b.node").alias("src_node"), F.col("b.pos").alias("src_pos"), F.col("next.a.node").alias("dst_node"), F.col("next.a.pos").alias("dst_pos"))
    return own.unionByName(gaps)


def annotated(found: DataFrame, k: int) -> DataFrame:
    """Breaks by what they look like from both sides: DELETION if the sequence goes on at once further along the same node, INSERTION if the node goes on at once but the sequence has more, PARALLEL if both have as much between, else BREAK."""
    seq_gap, node_gap = F.col("seq_end") - F.col("seq_begin"), F.col("dst_pos") - F.col("src_pos") - k
    same = F.col("src_node") == F.col("dst_node")
    kind = F.when(F.col("type") == "CONTIG", "CONTIG").when(same & (seq_gap == node_gap), "PARALLEL").when(same & (node_gap > seq_gap), "DELETION").when(same & (seq_gap > node_gap), "INSERTION").otherwise("BREAK")
    return found.withColumn("type", kind)


def segment_statistics(found: DataFrame) -> DataFrame:
    """(type, n, length)."""
    return found.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.greatest(F.col("seq_end") - F.col("seq_begin"), F.lit(0))).alias("length"))


def node_chains(steps: DataFrame) -> DataFrame:
    """(read_id, seg_no, chain): the signed nodes that each stretch goes through, in order."""
    some = islands(steps).filter("kind <> 'inside'")
    return some.groupBy("read_id", "seg_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("offset", "node"))), lambda x: x["node"]).alias("chain"))


def true_multiplicities(steps: DataFrame, nodes: DataFrame, arcs: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(node_id, mult) with the rounded mean number of times that the sequences have a node's k-mers, and (src, dst, mult) with the number of crossings; 0 where there is none."""
    seen = steps.groupBy(F.abs("node").alias("node_id")).agg(F.count(F.lit(1)).alias("n"))
    by_node = nodes.select("node_id", S.marginal_length(F.col("seq"), k).alias("mlen")).join(seen, "node_id", "left").select("node_id", F.round(F.coalesce("n", F.lit(0)) / F.col("mlen")).cast("int").alias("mult"))
    crossed = steps.filter("kind = 'arc'").select(S.edge(F.col("prev_node"), F.col("node")).alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("n")).select("e.*", "n")
    by_arc = arcs.select("src", "dst").join(crossed, ["src", "dst"], "left").select("src", "dst", F.coalesce("n", F.lit(0)).cast("int").alias("mult"))
    return by_node, by_arc


def alignment_metrics(found: DataFrame) -> DataFrame:
    """Totals of read alignments (aligned, n_subst, n_indel, path)."""
    return found.agg(F.count(F.lit(1)).alias("reads"), F.sum(F.col("aligned").cast("int")).alias("aligned"), F.avg("n_subst").alias("mean_subst"), F.avg("n_indel").alias("mean_indel"), F.max(F.size("path")).alias("longest"))
