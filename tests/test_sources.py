import gzip

import pytest
from pyspark.errors import PySparkException

from strandloom.operators.model import CovModel
from strandloom.sources import fastq, graphs
from strandloom.streaming import kmer_stream

RECORDS = [("r1", "ACGTN", "IIII!"), ("r2", "AC", "@I"), ("r3", "ggta", "@@@@"), ("r4", "ACGTACGT", "IIIIIIII")]


def text(records):
    return "".join(f"@{a}\n{b}\n+\n{c}\n" for a, b, c in records)


def test_fastq(spark, tmp_path):
    (tmp_path / "a.fq").write_text(text(RECORDS))
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write(text(RECORDS[:2]))
    found = fastq.read_fastq(spark, str(tmp_path / "a.fq")).orderBy("read_id").collect()
    assert [(r.seq_id, r.seq, r.qual) for r in found] == RECORDS
    (tmp_path / "m.mf").write_text(f"{tmp_path}/a.fq, {tmp_path}/b.fq.gz\n\n{tmp_path}/a.fq\n")
    assert [x[2] is None for x in fastq.read_manifest(spark, str(tmp_path / "m.mf"))] == [False, True]
    assert fastq.read_libraries(spark, str(tmp_path / "m.mf")).count() == 10
    pairs = fastq.read_paired(spark, str(tmp_path / "a.fq"), str(tmp_path / "b.fq.gz"))
    assert sorted(r.read_id for r in fastq.unpaired(pairs).collect()) == [2, 3]


def test_fastq_split_in_many_places(spark, tmp_path):
    records = [(f"r{i}", "ACGT" * (i % 7 + 1), "@III" * (i % 7 + 1)) for i in range(500)]
    (tmp_path / "a.fq").write_text(text(records))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")
    try:
        df = fastq.read_fastq(spark, str(tmp_path / "a.fq"))
        assert [(r.seq_id, r.seq, r.qual) for r in df.orderBy("read_id").collect()] == records
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_fastq_ends_and_errors(spark, tmp_path):
    (tmp_path / "a.fq").write_text(text(RECORDS[:1]) + "@e\n\n+\n\n" + text(RECORDS[1:]))
    assert fastq.read_fastq(spark, str(tmp_path / "a.fq")).count() == 1
    (tmp_path / "b.fq").write_text("r1\nAC\n+\nII\n")
    with pytest.raises(PySparkException):
        fastq.read_fastq(spark, str(tmp_path / "b.fq")).collect()
    (tmp_path / "m.mf").write_text("reads.txt\n")
    with pytest.raises(ValueError):
        fastq.read_manifest(spark, str(tmp_path / "m.mf"))


def test_fasta(spark, tmp_path):
    (tmp_path / "g.fasta").write_text(">one x\nACGT\nAC\n>two\nGGG\n")
    assert [(r.seq_id, r.seq) for r in fastq.read_fasta(spark, str(tmp_path / "g.fasta")).collect()] == [("one x", "ACGTAC"), ("two", "GGG")]


def test_unitigs_round_trip(spark, tmp_path):
    (tmp_path / "u.fa").write_text(">0 LN:i:5 KC:i:7 km:f:2.3 L:+:1:+ L:+:2:-\nACGTA\n>1 LN:i:4 KC:i:2 km:f:1.0 L:-:0:-\nTAGG\n>2 LN:i:4 KC:i:2 km:f:1.0 L:+:0:-\nCCTA\n")
    nodes, arcs = graphs.read_unitigs(spark, str(tmp_path / "u.fa"))
    assert sorted((r.src, r.dst) for r in arcs.collect()) == [(-2, -1), (1, -3)]
    back = nodes.withColumnRenamed("kc", "cov")
    graphs.unitig_text(back, arcs).coalesce(1).write.text(str(tmp_path / "out"))
    again, arcs2 = graphs.read_unitigs(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, nodes.collect())) and sorted(map(tuple, arcs2.collect())) == sorted(map(tuple, arcs.collect()))


def test_k_is_inferred_or_refused(spark):
    nodes = spark.createDataFrame([(1, "AACGT"), (2, "GTAA"), (3, "GTCC")], "node_id int, seq string")
    arcs = spark.createDataFrame([(-2, -1, 0.0), (-3, -1, 0.0)], "src int, dst int, cov double")
    assert graphs.infer_k(nodes, arcs) == 3
    with pytest.raises(ValueError):
        graphs.infer_k(nodes, arcs.limit(0))


def test_model_and_properties():
    model = CovModel(1.0, 1.5, 12.0, 1.25, (100, 50, 5, 1, 1, 1))
    assert graphs.parse_model(graphs.model_text(model)) == model
    assert graphs.properties("% c\ntol\t1e-3\nupdates\tSEQMAX0L\n") == {"tol": "1e-3", "updates": "SEQMAX0L"}


def test_streaming_counts_equal_batch_counts(spark, tmp_path):
    from strandloom.operators.kmers import canonical_counts

    reads = spark.createDataFrame([(i, "ACGTTGCATTCAGGATC"[i % 5 :]) for i in range(40)], "read_id long, seq string")
    reads.repartition(4).write.parquet(str(tmp_path / "in"))
    kmer_stream.counts_by_batch(kmer_stream.read_stream(spark, str(tmp_path / "in"), max_files=1), 5, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(map(tuple, kmer_stream.current(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, canonical_counts(reads, 5).collect()))
