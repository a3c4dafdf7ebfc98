"""Graphs, models and tables on disk."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.operators.graph import both_strands
from strandloom.operators.model import CovModel
from strandloom.sources.fastq import fasta_records


def read_unitigs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, seq, kc) and arcs (src, dst, cov) of a unitig FASTA: `>id LN:i:n KC:i:n km:f:x L:<+|->:<id>:<+|-> ...` and one line of sequence. File ids count from 0, node ids from 1. Sequences of other letters than ACGT are an error."""
    records = fasta_records(spark, path)
    lines = F.split(F.rtrim("value"), "\r?\n")
    rows = records.select(F.element_at(lines, 1).alias("head"), F.element_at(lines, 2).alias("seq"))
    node = (F.regexp_extract("head", r"^(\d+)", 1).cast("int") + 1).alias("node_id")
    seq = F.when(S.is_acgt(F.col("seq")), F.col("seq")).otherwise(F.raise_error(F.lit("a unitig has other letters than ACGT")))
    nodes = rows.select(node, seq.alias("seq"), F.regexp_extract("head", r"KC:[if]:(\d+)", 1).cast("long").alias("kc"))
    links = rows.select(node, F.explode(F.regexp_extract_all("head", F.lit(r"(L:[+-]:\d+:[+-])"), F.lit(1))).alias("l"))
    own, other = F.substring("l", 3, 1), F.regexp_extract("l", r"L:.:(\d+):", 1).cast("int") + 1
    src = F.when(own == "+", F.col("node_id")).otherwise(-F.col("node_id"))
    dst = F.when(F.substring("l", -1, 1) == "+", other).otherwise(-other)
    arcs = links.select(S.edge(src, dst).alias("e")).distinct().select("e.src", "e.dst", F.lit(0.0).alias("cov"))
    return nodes, arcs


def infer_k(nodes: DataFrame, arcs: DataFrame) -> int:
    """k from a node with two ways out: the common prefix of what follows, plus 1. An error without such a node, or if k is even."""
    strands = both_strands(arcs)
    two = strands.groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("ways")).filter("size(ways) > 1").orderBy("src").limit(1).first()
    if two is None:
        raise ValueError("no node has two ways out: k can't be inferred")
    seqs = {r.node_id: r.seq for r in nodes.filter(F.col("node_id").isin([abs(w) for w in two.ways[:2]])).collect()}
    a, b = (seqs[abs(w)] if w > 0 else seqs[abs(w)][::-1].translate(str.maketrans("ACGT", "TGCA")) for w in two.ways[:2])
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) + 1
    if k % 2 == 0:
        raise ValueError(f"k is even: {k}")
    return k


def unitig_text(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """(value): records that read_unitigs reads again."""
    links = both_strands(arcs).select(F.abs("src").alias("node_id"), F.concat(F.lit(" L:"), F.when(F.col("src") > 0, "+").otherwise("-"), F.lit(":"), (F.abs("dst") - 1).cast("string"), F.lit(":"), F.when(F.col("dst") > 0, "+").otherwise("-")).alias("l"))
    links = links.groupBy("node_id").agg(F.array_join(F.sort_array(F.collect_list("l")), "").alias("links"))
    head = F.concat(F.lit(">"), (F.col("node_id") - 1).cast("string"), F.lit(" LN:i:"), F.length("seq").cast("string"), F.lit(" KC:i:"), F.col("cov").cast("long").cast("string"), F.coalesce("links", F.lit("")))
    return nodes.join(links, "node_id", "left").select(F.concat(head, F.lit("\n"), "seq").alias("value"))


def write_graph(nodes: DataFrame, arcs: DataFrame, path: str) -> None:
    nodes.write.parquet(f"{path}/nodes")
    arcs.write.parquet(f"{path}/arcs")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/arcs")


def model_text(model: CovModel) -> str:
    """Two lines: the parameters and K, the weights."""
    return "\t".join(map(repr, (model.err_lambda, model.err_odf, model.lam, model.odf))) + f"\t{model.k}\n" + "\t".join(map(repr, model.weights)) + "\n"


def parse_model(text: str) -> CovModel:
    first, second = text.strip().split("\n")[:2]
    err, err_odf, lam, odf, _ = map(float, first.split())
    return CovModel(err, err_odf, lam, odf, tuple(map(float, second.split())))


def gnuplot_script(name: str, model: CovModel) -> str:
    """A script that plots the spectrum table of a model with its histogram."""
    plots = [f'"{name}.dat" using 1:{model.k + 2} with boxes title "histogram"'] + [f'"{name}.dat" using 1:{m + 2} with lines title "multiplicity {m}"' for m in range(model.k)]
    return f'set terminal pdf\nset output "{name}.pdf"\nset xrange [0:{math.ceil((model.k + 1) * model.lam)}]\nplot ' + ", \\\n  ".join(plots) + "\n"


def write_thresholds(th: DataFrame, path: str) -> None:
    th.orderBy("a").coalesce(1).write.option("sep", " ").csv(path)


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("a int, th int, prob double").option("sep", " ").csv(path)


def read_spectrum(spark: SparkSession, path: str, k: int = 6) -> DataFrame:
    """The table (cov, p0.., hist) by names: fewer than 6 components are an error."""
    if k < 6:
        raise ValueError("thresholds need 6 components at least")
    return spark.read.schema("cov int, " + ", ".join(f"p{m} double" for m in range(k)) + ", hist double").option("sep", "\t").csv(path)


def read_ids(spark: SparkSession, path: str, nodes: DataFrame) -> DataFrame:
    """(node_id) from a text file; an id that the graph lacks is an error."""
    ids = spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("x")).filter("x <> ''").select(F.col("x").cast("int").alias("node_id"))
    if missing := ids.join(nodes, "node_id", "left_anti").head(1):
        raise ValueError(f"no such node: {missing[0].node_id}")
    return ids


def properties(text: str) -> dict[str, str]:
    """Keys and values between tabs; lines that begin with % are comments."""
    rows = (line.split("\t", 1) for line in text.splitlines() if line.strip() and not line.startswith("%"))
    return {k.strip(): v.strip() for k, v in rows}


def contig_text(contigs: DataFrame) -> DataFrame:
    """(value): FASTA records of contigs in order."""
    return contigs.orderBy("contig_id").select(F.concat(F.lit(">contig_"), F.col("contig_id").cast("string"), F.lit("\n"), S.wrap(F.col("seq"))).alias("value"))


def probability_text(contigs: DataFrame) -> DataFrame:
    """(value): the Phred strings of both directions."""
    from strandloom.operators.assemble import phred_strings

    one = lambda c: F.concat(F.lit(">contig_"), F.col("contig_id").cast("string"), F.lit(f"_{c}\n"), F.regexp_replace(F.regexp_replace(c, "(.{60})", "$1\n"), "\n$", ""))
    return phred_strings(contigs).orderBy("contig_id").select(F.concat(one("fwd"), F.lit("\n"), one("bwd")).alias("value"))


def cytoscape(nodes: DataFrame, arcs: DataFrame, true_nodes: DataFrame | None = None, est_nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Node and arc tables with true and estimated multiplicities, -1 where unknown."""
    table = nodes.select("node_id", F.length("seq").alias("length"), F.col("cov"))
    for name, df in (("true_mult", true_nodes), ("est_mult", est_nodes)):
        table = table.join(df.select("node_id", F.col("mult").alias(name)), "node_id", "left") if df is not None else table.withColumn(name, F.lit(None).cast("int"))
        table = table.withColumn(name, F.coalesce(name, F.lit(-1)))
    return table.withColumn("correct", (F.col("true_mult") == F.col("est_mult")).cast("int")), both_strands(arcs)


