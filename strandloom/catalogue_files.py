"""Queries on files and small functions: tables are written in a format, read again, and compared with what went in."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.catalogue import (
    EPSILON,
    EVENT_ARCS,
    EVENT_NODES,
    INDEX_K,
    INDEXED,
    MIXTURE,
    MODEL,
    PARTS,
    READS,
    SIDES,
    STEPS,
    THRESHOLDS,
    UNITIGS,
    bases,
    event_arcs,
    event_nodes,
    parts,
    query,
    reads,
    sql_bases,
    table,
    totals,
    unitig_arcs,
    unitig_nodes,
)
from strandloom.functions import nodes as N
from strandloom.functions import sequence as S
from strandloom.operators import coverage as C
from strandloom.operators import graph as G
from strandloom.operators import thresholds as T
from strandloom.operators.model import spectrum_table
from strandloom.plans.tables import place
from strandloom.sources import fastq, graphs, tables


def written(df, spark, label, name="file.txt"):
    """The path of a text file with the rows (value) of df."""
    path = f"{place(spark, label)}/{name}"
    df.write.text(path)
    return path


def seq_ids(spark, d):
    return reads(spark, d).filter("seq <> ''").select(F.concat(F.lit("doc>"), F.col("read_id").cast("string")).alias("seq_id"), "seq", F.expr("repeat('I', length(seq))").alias("qual"))


# Sequences in files.


@query("fastq_file", f"WITH {READS} SELECT 'doc>' || read_id AS seq_id, md5(seq) AS seq_md5, length(seq) AS n_qual FROM reads WHERE seq <> ''")
def fastq_file(spark, d):
    path = written(fastq.fastq_text(seq_ids(spark, d)), spark, "fastq", "reads.fastq")
    return fastq.read_fastq(spark, path).select("seq_id", F.md5("seq").alias("seq_md5"), F.length("qual").cast("long").alias("n_qual"))


@query("fastq_gz_file", f"WITH {READS} SELECT 'doc>' || read_id AS seq_id, md5(seq) AS seq_md5 FROM reads WHERE seq <> ''")
def fastq_gz_file(spark, d):
    path = f"{place(spark, 'fastq')}/reads.fastq.gz"
    fastq.fastq_text(seq_ids(spark, d)).write.option("compression", "gzip").text(path)
    return fastq.read_fastq(spark, path).select("seq_id", F.md5("seq").alias("seq_md5"))


TURNS = f"turns AS (SELECT conv_id, turn, {sql_bases('text')} AS seq FROM conversations)"


@query("paired_fastq_files", f"WITH {TURNS}, n AS (SELECT a.seq AS s1, b.seq AS s2 FROM turns a JOIN turns b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.turn % 2 = 0 AND a.seq <> '' AND b.seq <> '') SELECT md5(s1) AS one, md5(s2) AS two, count(*) AS n FROM n GROUP BY 1, 2")
def paired_fastq_files(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", bases(F.col("text")).alias("seq")).filter("seq <> ''")
    pairs = t.filter("turn % 2 = 0").select("conv_id", "turn", F.col("seq").alias("s1")).join(t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("seq").alias("s2")), ["conv_id", "turn"])
    pairs = pairs.orderBy("conv_id", "turn").coalesce(1)
    path = place(spark, "pairs")
    names = []
    for i in (1, 2):
        one = pairs.select(F.lit("r").alias("seq_id"), F.col(f"s{i}").alias("seq"), F.expr(f"repeat('I', length(s{i}))").alias("qual"))
        names.append(f"{path}/reads_{i}.fastq")
        fastq.fastq_text(one).write.text(names[-1])
    spark.createDataFrame([(" ".join(names),)], "value string").coalesce(1).write.text(f"{path}/library")
    found = fastq.read_libraries(spark, f"{path}/library")
    both = found.groupBy("lib_id", "read_id").pivot("mate", [1, 2]).agg(F.first("seq"))
    return both.groupBy(F.md5("1").alias("one"), F.md5("2").alias("two")).agg(F.count(F.lit(1)).alias("n"))


@query("fasta_file", f"WITH {READS} SELECT 'doc>' || read_id AS seq_id, md5(seq) AS seq_md5 FROM reads WHERE seq <> ''")
def fasta_file(spark, d):
    path = written(fastq.fasta_text(seq_ids(spark, d)), spark, "fasta", "reads.fasta")
    return fastq.read_fasta(spark, path).select("seq_id", F.md5("seq").alias("seq_md5"))


@query("file_types", "SELECT event_id, 'reads' || event_id % 7 AS name, ['FASTQ', 'FASTA', 'FASTQ_GZ', 'FASTA_GZ', 'UNKNOWN'][event_id % 5 + 1] AS type FROM events")
def file_types(spark, d):
    kinds = [fastq.file_type(f"/x/reads.{e}")[0] for e in ("fq", "FASTA", "fastq.gz", "fa.GZ", "bam")]
    return table(spark, d, "events").select("event_id", F.concat(F.lit("reads"), (F.col("event_id") % 7).cast("string")).alias("name"), F.element_at(F.array(*map(F.lit, kinds)), (F.col("event_id") % 5 + 1).cast("int")).alias("type"))


# Graphs in files.


@query("unitig_file", f"WITH {UNITIGS}, uarcs AS (SELECT -(b.node_id) AS src, -(a.node_id) AS dst FROM unitigs a JOIN unitigs b ON b.node_id = a.node_id + 1) SELECT node_id, md5(seq) AS seq_md5, (node_id * 3)::BIGINT AS kc, (SELECT count(*) FROM uarcs u WHERE abs(u.src) = n.node_id OR abs(u.dst) = n.node_id) AS n_arcs FROM unitigs n")
def unitig_file(spark, d):
    nodes = unitig_nodes(spark, d).withColumn("cov", (F.col("node_id") * 3).cast("double"))
    found, arcs = graphs.read_unitigs(spark, written(graphs.unitig_text(nodes, unitig_arcs(spark, d)), spark, "unitigs"))
    ends = arcs.select(F.explode(F.array(F.abs("src"), F.abs("dst"))).alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("n_arcs"))
    return found.join(ends, "node_id", "left").select("node_id", F.md5("seq").alias("seq_md5"), "kc", F.coalesce("n_arcs", F.lit(0).cast("long")).alias("n_arcs"))


@query("graph_file", f"WITH {EVENT_ARCS} SELECT src, dst, cov FROM arcs")
def graph_file(spark, d):
    path = place(spark, "graph")
    graphs.write_graph(event_nodes(spark, d), event_arcs(spark, d), path)
    return graphs.read_graph(spark, path)[1].select("src", "dst", "cov")


@query("node_list_file", f"WITH {EVENT_NODES} SELECT node_id FROM nodes WHERE node_id % 9 = 0")
def node_list_file(spark, d):
    nodes = event_nodes(spark, d)
    path = written(nodes.filter("node_id % 9 = 0").select(F.col("node_id").cast("string").alias("value")), spark, "ids")
    return graphs.read_ids(spark, path, nodes)


@query("arc_list_file", f"WITH {EVENT_ARCS} SELECT src, dst FROM arcs WHERE (src + dst) % 5 = 0")
def arc_list_file(spark, d):
    arcs = event_arcs(spark, d)
    path = written(arcs.filter("(src + dst) % 5 = 0").select((-F.col("dst")).alias("a"), (-F.col("src")).alias("b")).select(tables.text_of("a", "b")), spark, "arcs")
    return tables.read_arcs(spark, path, arcs)


@query("node_multiplicity_file", f"WITH {EVENT_NODES} SELECT node_id, CASE WHEN node_id % 3 = 0 THEN -1 ELSE mlen % 4 END::INT AS mult FROM nodes WHERE node_id % 2 = 0")
def node_multiplicity_file(spark, d):
    nodes, path = event_nodes(spark, d), place(spark, "mult")
    tables.write_node_multiplicities(nodes.filter("node_id % 3 <> 0").select("node_id", (F.col("mlen") % 4).alias("mult")), path)
    return tables.read_node_multiplicities(spark, path, nodes.filter("node_id % 2 = 0"))


@query("arc_multiplicity_file", f"WITH {EVENT_ARCS} SELECT src, dst, CASE WHEN (src - dst) % 3 = 0 THEN -1 ELSE abs(src) % 4 END::INT AS mult FROM arcs")
def arc_multiplicity_file(spark, d):
    arcs, path = event_arcs(spark, d), place(spark, "mult")
    some = arcs.filter("(src - dst) % 3 <> 0").select((-F.col("dst")).alias("s"), (-F.col("src")).alias("t"), (F.abs("src") % 4).alias("mult"))
    tables.write_arc_multiplicities(some.select(F.col("s").alias("src"), F.col("t").alias("dst"), "mult"), path)
    return tables.read_arc_multiplicities(spark, path, arcs)


@query("estimate_file", f"WITH {EVENT_NODES} SELECT node_id, mlen % 5 AS mult, -(mlen / 8) AS log_prob FROM nodes")
def estimate_file(spark, d):
    rows = event_nodes(spark, d).select("node_id", (F.col("mlen") % 5).alias("mult"), (-F.col("mlen") / 8).alias("log_prob"), "cov", "mlen")
    return tables.read_node_estimates(spark, written(rows.select(tables.text_of("node_id", "mult", "log_prob", "cov", "mlen")), spark, "estimates"))


@query("alignment_file", "SELECT (row_number() OVER (ORDER BY user_id) - 1)::BIGINT AS read_id, array_to_string(list((event_id % 9 - 4)::INT ORDER BY ts, event_id), ',') AS chain FROM events GROUP BY user_id")
def alignment_file(spark, d):
    chains = table(spark, d, "events").groupBy(F.col("user_id").alias("read_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id"))), lambda x: (x["event_id"] % 9 - 4).cast("int")).alias("chain"))
    found = tables.read_alignments(spark, written(tables.alignment_text(chains).coalesce(1), spark, "aln"))
    return found.select("read_id", F.array_join(F.col("chain").cast("array<string>"), ",").alias("chain"))


@query(
    "aligned_sequences",
    f"""WITH {INDEXED}, {STEPS}, isl AS (SELECT *, sum(CASE WHEN kind IN ('gap', 'break') THEN 1 ELSE 0 END) OVER (PARTITION BY read_id ORDER BY off) AS seg FROM kinds),
        c AS (SELECT read_id, seg, min(off) AS a, max(off) AS b FROM isl GROUP BY 1, 2)
        SELECT (row_number() OVER (ORDER BY c.read_id, a) - 1)::INT AS contig_id, md5(substr(r.seq, a + 1, b + {INDEX_K} - a)) AS seq_md5 FROM c JOIN reads r USING (read_id)""",
)
def aligned_sequences(spark, d):
    from strandloom.operators import compare

    r = reads(spark, d)
    hit = C.hits(r, C.kmer_index(unitig_nodes(spark, d), INDEX_K), INDEX_K)
    return tables.aligned_records(compare.segments(C.steps(hit, unitig_arcs(spark, d)), INDEX_K), r).select("contig_id", F.md5("seq").alias("seq_md5"))


@query("index_file", f"WITH {INDEXED} SELECT kmer, p[1] AS node_id, p[2] AS pos FROM index")
def index_file(spark, d):
    path = place(spark, "index")
    tables.write_index(C.kmer_index(unitig_nodes(spark, d), INDEX_K), path)
    return tables.read_index(spark, path).select("kmer", "node_id", F.col("pos").cast("long").alias("pos"))


@query("evidence_file", "SELECT row, var, state FROM (SELECT row_number() OVER (ORDER BY event_id) AS row, unnest(['a', 'b', 'c']) AS var, unnest([(event_id % 4)::INT, CASE WHEN event_id % 3 = 0 THEN NULL ELSE (event_id % 5)::INT END, (event_id % 2)::INT]) AS state FROM events) WHERE state IS NOT NULL")
def evidence_file(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat_ws("\t", (F.col("event_id") % 4).cast("string"), F.when(F.col("event_id") % 3 == 0, "").otherwise((F.col("event_id") % 5).cast("string")), (F.col("event_id") % 2).cast("string")).alias("value"))
    rows = e.unionByName(spark.createDataFrame([(-1, "a\tb\tc")], "event_id long, value string")).orderBy("event_id").select("value")
    return tables.read_evidence(spark, written(rows.coalesce(1), spark, "evidence"))


@query("spectrum_file", f"WITH {PARTS}, {MIXTURE}, h AS (SELECT cov, sum(weight) AS hist FROM (SELECT floor(avg)::INT AS cov, 1 - (avg - floor(avg)) AS weight FROM parts UNION ALL SELECT floor(avg)::INT + 1, avg - floor(avg) FROM parts) WHERE weight > 0 GROUP BY 1) SELECT m.cov, round(p0, 9) AS p0, round(p1, 9) AS p1, round(p5, 9) AS p5, round(coalesce(hist, 0), 6) AS hist FROM mixture m LEFT JOIN h USING (cov)")
def spectrum_file(spark, d):
    made = spectrum_table(spark, MODEL, C.split_histogram(parts(spark, d)))
    found = graphs.read_spectrum(spark, written(tables.spectrum_text(made, MODEL.k), spark, "spectrum"), MODEL.k)
    return found.select("cov", *[F.round(c, 9).alias(c) for c in ("p0", "p1", "p5")], F.round("hist", 6).alias("hist"))


@query("threshold_file", f"WITH {THRESHOLDS} SELECT a, th FROM ths")
def threshold_file(spark, d):
    path = place(spark, "thresholds")
    graphs.write_thresholds(T.thresholds(totals(spark), EPSILON), path)
    return graphs.read_thresholds(spark, path).select("a", "th")


@query("model_file", f"WITH {PARTS} SELECT node_id, {MODEL.lam} * avg AS scaled, {MODEL.k} AS k FROM parts")
def model_file(spark, d):
    path = written(spark.createDataFrame([(graphs.model_text(MODEL).rstrip("\n"),)], "value string").coalesce(1), spark, "model")
    model = graphs.parse_model(spark.read.text(path, wholetext=True).first().value)
    return parts(spark, d).select("node_id", (F.lit(model.lam) * F.col("avg")).alias("scaled"), F.lit(model.k).alias("k"))


NETWORK = f"{EVENT_NODES}, {EVENT_ARCS}, {SIDES}"


def network(spark, d):
    nodes, arcs = event_nodes(spark, d).withColumn("seq", F.expr("repeat('A', mlen + 4)")), event_arcs(spark, d)
    true = nodes.filter("node_id % 2 = 0").select("node_id", (F.col("mlen") % 3).alias("mult"))
    est = nodes.filter("node_id % 3 = 0").select("node_id", (F.col("mlen") % 2).alias("mult"), F.lit(1.5).alias("log_odds"), F.lit(0.0).alias("log_prob"))
    true_arcs = arcs.filter("src % 2 = 0").select("src", "dst", F.lit(1).alias("mult"))
    est_arcs = arcs.filter("dst % 2 = 0").select("src", "dst", F.lit(1).alias("mult"), F.lit(0.5).alias("log_odds"), F.lit(0.0).alias("log_prob"))
    path = f"{place(spark, 'network')}/graph"
    tables.write_network(tables.network_tables(nodes, arcs, 5, true, est, true_arcs, est_arcs), path)
    read = lambda name: spark.read.option("sep", "\t").option("header", True).option("inferSchema", True).csv(f"{path}.{name}")
    return read("nodes"), read("arcs")


@query("network_nodes", f"WITH {NETWORK} SELECT node_id AS node, mlen AS marginal_length, n_left::INT AS n_left, n_right::INT AS n_right, round(cov / mlen, 6) AS avg, t AS true_mult, e AS est_mult, CASE WHEN node_id % 3 = 0 THEN 1.5 ELSE -1 END::DOUBLE AS lor, CASE WHEN node_id % 3 = 0 THEN 1 ELSE -1 END::DOUBLE AS belief, (t = e)::INT AS correct, mlen + 4 AS n FROM (SELECT *, CASE WHEN node_id % 2 = 0 THEN mlen % 3 ELSE -1 END::INT AS t, CASE WHEN node_id % 3 = 0 THEN mlen % 2 ELSE -1 END::INT AS e FROM nodes JOIN sides USING (node_id))")
def network_nodes(spark, d):
    found = network(spark, d)[0].toDF("node", "marginal_length", "n_left", "n_right", "avg", "true_mult", "est_mult", "lor", "belief", "correct", "seq")
    return found.withColumn("avg", F.round("avg", 6)).withColumn("n", F.length("seq")).drop("seq")


@query("network_arcs", f"WITH {EVENT_ARCS} SELECT src, dst, cov, CASE WHEN src % 2 = 0 THEN 1 ELSE -1 END::INT AS true_mult, CASE WHEN dst % 2 = 0 THEN 1 ELSE -1 END::INT AS est_mult, CASE WHEN dst % 2 = 0 THEN 0.5 ELSE -1 END::DOUBLE AS lor, CASE WHEN dst % 2 = 0 THEN 1 ELSE -1 END::DOUBLE AS belief, ((src % 2 = 0) = (dst % 2 = 0))::INT AS correct FROM arcs")
def network_arcs(spark, d):
    return network(spark, d)[1].toDF("src", "dst", "cov", "true_mult", "est_mult", "lor", "belief", "correct")


# Small functions.


@query("pushed_windows", f"WITH {READS}, w AS (SELECT read_id, seq, (length(seq) // 2)::INT AS o, substr(seq, length(seq) // 2 + 1, 9) AS kmer FROM reads WHERE length(seq) >= 40) SELECT read_id, substr(kmer, 2) || 'G' AS ahead, 'T' || substr(kmer, 1, 8) AS back, substr(kmer, 1, 1) AS first, substr(kmer, 9, 1) AS last, substr(seq, o, 1) AS before, substr(seq, o + 10, 1) AS after FROM w")
def pushed_windows(spark, d):
    r = reads(spark, d).filter("length(seq) >= 40").withColumn("o", F.expr("cast(length(seq) div 2 as int)")).withColumn("kmer", F.substring("seq", F.col("o") + 1, F.lit(9)))
    k, s, o = F.col("kmer"), F.col("seq"), F.col("o")
    return r.select("read_id", N.push_right(k, F.lit("G")).alias("ahead"), N.push_left(k, F.lit("T")).alias("back"), N.first_base(k).alias("first"), N.last_base(k).alias("last"), N.base_before(s, o).alias("before"), N.base_after(s, o, 9).alias("after"))


@query("marginal_bases", f"WITH {UNITIGS} SELECT node_id, substr(seq, {INDEX_K}, 1) AS left_base, substr(seq, length(seq) - {INDEX_K} + 1, 1) AS right_base FROM unitigs")
def marginal_bases(spark, d):
    return unitig_nodes(spark, d).select("node_id", N.marginal_left(F.col("seq"), INDEX_K).alias("left_base"), N.marginal_right(F.col("seq"), INDEX_K).alias("right_base"))


@query("neighbours_by_base", f"WITH {UNITIGS}, uarcs AS (SELECT -(b.node_id) AS src, -(a.node_id) AS dst FROM unitigs a JOIN unitigs b ON b.node_id = a.node_id + 1), s AS (SELECT src, dst FROM uarcs UNION ALL SELECT -dst, -src FROM uarcs) SELECT s.src, substr(CASE WHEN s.dst < 0 THEN translate(reverse(n.seq), 'ACGT', 'TGCA') ELSE n.seq END, {INDEX_K}, 1) AS base, min(s.dst) AS dst FROM s JOIN unitigs n ON n.node_id = abs(s.dst) GROUP BY 1, 2")
def neighbours_by_base(spark, d):
    return N.neighbours_by_base(unitig_nodes(spark, d), unitig_arcs(spark, d), INDEX_K)


@query("arc_existence", f"WITH {EVENT_NODES}, {EVENT_ARCS}, p AS (SELECT DISTINCT (event_id % 500 + 1)::INT AS src, (CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * (event_id % 499 + 1))::INT AS dst FROM events) SELECT src, dst, EXISTS (SELECT 1 FROM strands s WHERE s.src = p.src AND s.dst = p.dst) AS exists FROM p")
def arc_existence(spark, d):
    pairs = table(spark, d, "events").select((F.col("event_id") % 500 + 1).cast("int").alias("src"), (F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1) * (F.col("event_id") % 499 + 1)).cast("int").alias("dst")).distinct()
    return N.with_existing(pairs, event_nodes(spark, d), event_arcs(spark, d))


CHAINS = "chains AS (SELECT user_id AS id, list((CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END * (event_id // 2 + 1))::INT ORDER BY ts, event_id) AS chain FROM events WHERE event_type <> 'click' OR user_id % 2 = 0 GROUP BY 1)"


def chains(spark, d):
    e = table(spark, d, "events").filter("event_type <> 'click' OR user_id % 2 = 0")
    node = lambda x: (F.when(x["event_id"] % 3 == 0, -1).otherwise(1) * (F.floor(x["event_id"] / 2) + 1)).cast("int")
    return e.groupBy(F.col("user_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id"))), node).alias("chain"))


@query("path_existence", f"WITH {EVENT_NODES}, {EVENT_ARCS}, {CHAINS}, s AS (SELECT id, chain[i] AS src, chain[i + 1] AS dst FROM (SELECT *, unnest(range(1, len(chain))) AS i FROM chains)), m AS (SELECT id, bool_and(EXISTS (SELECT 1 FROM strands t WHERE t.src = s.src AND t.dst = s.dst)) AS ok FROM s GROUP BY 1) SELECT c.id, coalesce(m.ok, true) AS exists FROM chains c LEFT JOIN m USING (id)")
def path_existence(spark, d):
    return N.with_existing_path(chains(spark, d), event_nodes(spark, d), event_arcs(spark, d))


@query("path_coverage", f"WITH {EVENT_NODES}, {CHAINS} SELECT c.id, round(sum(n.cov) / sum(n.mlen), 6) AS coverage FROM (SELECT id, unnest(chain) AS node FROM chains) c JOIN nodes n ON n.node_id = abs(c.node) GROUP BY 1")
def path_coverage(spark, d):
    return N.path_coverage(chains(spark, d), event_nodes(spark, d)).select("id", F.round("coverage", 6).alias("coverage"))


@query("chain_order", f"WITH {CHAINS} SELECT a.id, list_contains(a.chain, 5) OR list_contains(a.chain, -5) AS has, a.chain < b.chain AS before FROM chains a JOIN chains b ON b.id = a.id + 1")
def chain_order(spark, d):
    c = chains(spark, d)
    both = c.join(c.select((F.col("id") - 1).alias("id"), F.col("chain").alias("other")), "id")
    return both.select("id", N.chain_contains(F.col("chain"), F.lit(5)).alias("has"), N.chain_before(F.col("chain"), F.col("other")).alias("before"))


@query("human_times", "SELECT o_orderkey, CASE WHEN t >= 86400 THEN t // 86400 || 'd ' || t % 86400 // 3600 || 'h ' || t % 3600 // 60 || 'min' WHEN t >= 3600 THEN t // 3600 || 'h ' || t % 3600 // 60 || 'min ' || t % 60 || 's' WHEN t >= 60 THEN t // 60 || 'min ' || t % 60 || 's' WHEN t > 0 THEN t || 's 250ms' ELSE '250ms' END AS time FROM (SELECT o_orderkey, o_orderkey * 7 % 100000 // (o_orderkey % 900 + 1) AS t FROM orders)")
def human_times(spark, d):
    t = F.expr("cast(o_orderkey * 7 % 100000 div (o_orderkey % 900 + 1) as double) + 0.25")
    return table(spark, d, "orders").select("o_orderkey", N.human_time(t).alias("time"))


@query("bit_ranks", "SELECT user_id, array_to_string(list_transform(range(0, len(b)), lambda i: len(list_filter(b[1:i], lambda x: x))), ',') AS ranks FROM (SELECT user_id, list(event_id % 3 = 0 ORDER BY ts, event_id) AS b FROM events GROUP BY 1)")
def bit_ranks(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id"))), lambda x: x["event_id"] % 3 == 0).alias("b"))
    return e.select("user_id", F.array_join(N.rank(F.col("b")).cast("array<string>"), ",").alias("ranks"))
