"""Tables beside the graph: multiplicities, alignments, indexes, evidence, spectra and network exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.operators.graph import numbered, sides


def text_of(*columns: str, sep: str = "\t") -> Column:
    return F.concat_ws(sep, *[F.col(c).cast("string") for c in columns]).alias("value")


def fields(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of fields between white space; a row of fewer fields, or with others than the schema says, ends nothing and is left out."""
    names = [x.strip().split(" ") for x in schema.split(",")]
    split = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(F.size(split) >= len(names)).select(*[split[i].try_cast(kind).alias(name) for i, (name, kind) in enumerate(names)])
    return rows.na.drop()


def write_node_multiplicities(mult: DataFrame, path: str) -> None:
    mult.select(text_of("node_id", "mult")).write.text(path)


def write_arc_multiplicities(mult: DataFrame, path: str) -> None:
    mult.select(text_of("src", "dst", "mult")).write.text(path)


def read_node_multiplicities(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(node_id, mult) of the wanted nodes; -1 where the file has none."""
    found = fields(spark, path, "node_id int, mult int")
    return wanted.select("node_id").join(found, "node_id", "left").withColumn("mult", F.coalesce("mult", F.lit(-1)))


def read_arc_multiplicities(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(src, dst, mult) of the wanted arcs, whichever strand the file names; -1 where it has none."""
    found = fields(spark, path, "src int, dst int, mult int").select(S.edge(F.col("src"), F.col("dst")).alias("e"), "mult").select("e.*", "mult")
    return wanted.select("src", "dst").join(found, ["src", "dst"], "left").withColumn("mult", F.coalesce("mult", F.lit(-1)))


def read_node_estimates(spark: SparkSession, path: str) -> DataFrame:
    """(node_id, mult, log_prob) of a table of estimates, which has two more columns."""
    return fields(spark, path, "node_id int, mult int, log_prob double, cov double, mlen int").select("node_id", "mult", "log_prob")


def read_arc_estimates(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, mult, log_prob) of a table of estimates, which has one more column."""
    return fields(spark, path, "src int, dst int, mult int, log_prob double, cov double").select(S.edge(F.col("src"), F.col("dst")).alias("e"), "mult", "log_prob").select("e.*", "mult", "log_prob")


def read_arcs(spark: SparkSession, path: str, arcs: DataFrame) -> DataFrame:
    """(src, dst) from a text file, in canonical form; an arc that the graph lacks is an error."""
    found = fields(spark, path, "src int, dst int").select(S.edge(F.col("src"), F.col("dst")).alias("e")).select("e.*")
    if missing := found.join(arcs, ["src", "dst"], "left_anti").head(1):
        raise ValueError(f"no such arc: {missing[0].src} {missing[0].dst}")
    return found


def alignment_text(chains: DataFrame) -> DataFrame:
    """(value): the nodes of each read's path (read_id, chain) between tabs, reads in order; a read without a path is an empty line."""
    return chains.orderBy("read_id").select(F.concat_ws("\t", F.col("chain").cast("array<string>")).alias("value"))


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, chain) with reads numbered from 0."""
    from strandloom.sources.fastq import numbered_lines

    return numbered_lines(spark, path).select(F.col("line").alias("read_id"), F.when(F.col("value") == "", F.array().cast("array<int>")).otherwise(F.split("value", "\t").cast("array<int>")).alias("chain"))


def aligned_records(segments: DataFrame, seqs: DataFrame) -> DataFrame:
    """(contig_id, seq): the stretches of sequences (read_id, seq) that lie on the graph, numbered from 0 in order."""
    parts = segments.filter("type = 'CONTIG'").join(seqs.select("read_id", "seq"), "read_id")
    parts = parts.select(F.struct("read_id", "seq_begin").alias("at"), F.substring("seq", F.col("seq_begin").cast("int") + 1, (F.col("seq_end") - F.col("seq_begin")).cast("int")).alias("seq"))
    return numbered(parts, "at", "contig_id").select((F.col("contig_id") - 1).alias("contig_id"), "seq")


def write_index(index: DataFrame, path: str) -> None:
    index.write.parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """(row, var, state): a table of joint observations; the first line names variables, an empty field is one that was not seen."""
    from strandloom.sources.fastq import numbered_lines

    lines = numbered_lines(spark, path).select("line", F.split("value", "\t", -1).alias("x"))
    head = lines.filter("line = 0").first()
    names = F.array(*[F.lit(x) for x in (head.x if head else [])]).cast("array<string>")
    seen = lines.filter("line > 0").select(F.col("line").alias("row"), F.explode(F.arrays_zip(names.alias("names"), F.col("x"))).alias("z")).filter("z.x <> ''")
    return seen.select("row", F.col("z.names").alias("var"), F.col("z.x").cast("int").alias("state"))


def spectrum_text(table: DataFrame, k: int) -> DataFrame:
    """(value): a spectrum table, counts in order, columns between tabs."""
    return table.orderBy("cov").select(text_of("cov", *[f"p{m}" for m in range(k)], "hist"))


#: Heads of the network tables (fixed values).
NODE_HEAD = ("Node ID", "Marginal length", "Left arcs", "Right arcs", "Coverage", "True mult.", "Est. mult.", "LOR", "Belief", "correct", "Sequence")
ARC_HEAD = ("Source node", "Target node", "Coverage", "True mult.", "Est mult.", "LOR", "Belief", "correct")


def network_tables(nodes: DataFrame, arcs: DataFrame, k: int, true_nodes: DataFrame | None = None, est_nodes: DataFrame | None = None, true_arcs: DataFrame | None = None, est_arcs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The two tables of a network export, of a whole graph or of a neighbourhood: columns as in NODE_HEAD and ARC_HEAD.

    Nodes have node_id, seq and cov, arcs src, dst and cov; true tables have mult, estimates mult, log_odds and log_prob. What
    isn't known is -1.
    """

    def rated(df: DataFrame, keys: list[str], true: DataFrame | None, est: DataFrame | None) -> DataFrame:
        none = lambda *names: [F.lit(None).cast("double").alias(x) for x in names]
        df = df.join(true.select(*keys, F.col("mult").alias("true_mult")), keys, "left") if true is not None else df.select("*", *none("true_mult"))
        df = df.join(est.select(*keys, F.col("mult").alias("est_mult"), "log_odds", F.exp("log_prob").alias("belief")), keys, "left") if est is not None else df.select("*", *none("est_mult", "log_odds", "belief"))
        df = df.withColumns({c: F.coalesce(F.col(c), F.lit(-1)).cast(t) for c, t in (("true_mult", "int"), ("est_mult", "int"), ("log_odds", "double"), ("belief", "double"))})
        return df.withColumn("correct", (F.col("true_mult") == F.col("est_mult")).cast("int"))

    mlen = S.marginal_length(F.col("seq"), k)
    given = nodes.select("node_id", "seq", (F.col("cov") / mlen).alias("avg"), mlen.alias("mlen")).join(sides(nodes, arcs), "node_id")
    node_table = rated(given, ["node_id"], true_nodes, est_nodes).select("node_id", "mlen", "n_left", "n_right", "avg", "true_mult", "est_mult", "log_odds", "belief", "correct", "seq").toDF(*NODE_HEAD)
    arc_table = rated(arcs.select("src", "dst", "cov"), ["src", "dst"], true_arcs, est_arcs).select("src", "dst", "cov", "true_mult", "est_mult", "log_odds", "belief", "correct").toDF(*ARC_HEAD)
    return node_table, arc_table


def write_network(tables: tuple[DataFrame, DataFrame], path: str) -> None:
    for table, name in zip(tables, ("nodes", "arcs"), strict=True):
        table.write.option("sep", "\t").option("header", True).csv(f"{path}.{name}")


def neighbourhood_tables(nodes: DataFrame, arcs: DataFrame, seed: int, depth: int, k: int, **known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The network tables of what lies within some arcs of a node."""
    from strandloom.operators.graph import neighbourhood

    start = nodes.filter(F.col("node_id") == abs(seed)).select(F.col("node_id").alias("seed"))
    near = neighbourhood(arcs, start, depth).select("node_id")
    some = nodes.join(near, "node_id", "left_semi")
    between = arcs
    for side in ("src", "dst"):
        between = between.join(near.select(F.col("node_id").alias("__n")), F.abs(side) == F.col("__n"), "left_semi")
    return network_tables(some, between, k, **known)
