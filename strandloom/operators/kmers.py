"""k-mers of reads: windows, canonical counts, spectra, arcs from (k+1)-mers, unitigs.

Up to PACKED bases a window is a number of two bits a base, rolled over whole batches of reads in a few vectorised steps;
numbers of one length are ordered as their strings are, so the canonical one is the least of two numbers, and keys that are
shuffled have 8 bytes. Longer windows are strings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.session import ship

#: Bases of a window that fit a signed 64-bit number; bases that are rolled at once; bytes of a batch whose reads are looked at together.
PACKED, SLAB, SLICE = 31, 1 << 17, 1 << 21
#: Windows that are counted in one array, if there can't be more; parts that more of them are dealt to; windows that are added up before they are dealt.
DENSE, PARTS, BLOCK = 1 << 22, 1 << 12, 1 << 20
#: Bases of a piece of a long read; pieces overlap by k - 1.
PIECE = 4096


def pieces(reads: DataFrame, k: int, id_col: str = "read_id", seq_col: str = "seq") -> DataFrame:
    """(read_id, start, part): reads cut into overlapping pieces, so that a task's rows stay small and long reads spread."""
    starts = F.when(F.length(seq_col) >= k, F.sequence(F.lit(0), F.length(seq_col) - k, F.lit(PIECE - k + 1)))
    return reads.select(F.col(id_col).alias("read_id"), F.col(seq_col).alias("seq"), F.explode(starts).alias("start")).select("read_id", "start", F.expr(f"substring(seq, start + 1, {PIECE})").alias("part"))


def kmers(reads: DataFrame, k: int) -> DataFrame:
    """(kmer): every window of k letters of ACGT of every read."""
    return pieces(reads, k).select(F.explode(S.windows(F.col("part"), k)).alias("kmer"))


def kmer_offsets(reads: DataFrame, k: int) -> DataFrame:
    """(read_id, offset, kmer): the same windows with their places in the read."""
    found = pieces(reads, k).select("read_id", "start", F.posexplode(S.all_windows(F.col("part"), k)).alias("place", "kmer"))
    return found.filter(S.is_acgt(F.col("kmer"))).select("read_id", (F.col("start") + F.col("place")).alias("offset"), "kmer")


CODES = np.full(256, 4, np.uint8)
CODES[np.frombuffer(b"ACGT", np.uint8)] = range(4)


def rolled(bases: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of k bases (as bytes) as numbers, their reverse complements, and which of them have no letter but ACGT. Windows of 2, 4, 8 ... bases are put together from their halves."""
    n = len(bases) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    codes = CODES[bases]
    bad = np.concatenate(([0], np.cumsum(codes > 3)))
    ahead, back, size = (codes & 3).astype(np.int64), (3 - (codes & 3)).astype(np.int64), 1
    whole, done = None, 0
    while True:
        if k & size:  # these bases come after those done
            m = len(bases) - done - size + 1
            a, b = ahead[done : done + m], back[done : done + m]
            whole = (a, b) if whole is None else ((whole[0][:m] << 2 * size) | a, (b << 2 * done) | whole[1][:m])
            done += size
        if done == k:
            return whole[0], whole[1], bad[k:] == bad[:-k]
        ahead, back = (ahead[:-size] << 2 * size) | ahead[size:], (back[size:] << 2 * size) | back[:-size]
        size *= 2


def slabs(column: pa.Array, k: int):
    """Reads of a batch, about SLAB bases at a time: bases, with an N after every read, the reads' numbers, their starts, and the offset of the first read's part. Long reads are cut into parts that overlap by k - 1."""
    data, reads, starts, first, size = [], [], [], 0, 0
    for i, seq in enumerate(column.to_pylist()):
        seq, at = (seq or "").encode("ascii", "replace"), 0
        while len(seq) - at >= k:
            part = seq[at : at + SLAB]
            if not data:
                first = at
            data.append(part)
            reads.append(i)
            starts.append(size)
            size += len(part) + 1
            at += len(part) - k + 1
            if size >= SLAB:
                yield np.frombuffer(b"N".join(data), np.uint8), reads, starts, first
                data, reads, starts, size = [], [], [], 0
            if len(part) < SLAB:
                break
    if data:
        yield np.frombuffer(b"N".join(data), np.uint8), reads, starts, first


def slices(batches):
    """Arrow batches in slices of about SLICE bytes, so that a worker's memory does not follow the length of reads."""
    for batch in batches:
        step = max(1, int(len(batch) * min(1.0, SLICE / max(batch.nbytes, 1))))
        for at in range(0, len(batch), step):
            yield batch.slice(at, step)


def added(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and the sums of their n."""
    order = np.argsort(codes)
    codes = codes[order]
    starts = np.flatnonzero(np.concatenate((codes[:1] == codes[:1], codes[1:] != codes[:-1])))
    return codes[starts], np.add.reduceat(n[order], starts) if len(starts) else n


def tables(codes: np.ndarray, n: np.ndarray):
    for at in range(0, len(codes), SLAB):
        yield pa.RecordBatch.from_arrays([pa.array(codes[at : at + SLAB]), pa.array(n[at : at + SLAB])], ["code", "n"])


def packed_counts(reads: DataFrame, k: int, least: int = 1) -> DataFrame:
    """(code, n): canonical k-mers of up to PACKED bases as numbers that occur at least `least` times.

    Short ones are counted in one array for each task. Others are dealt by a hash to PARTS parts, as runs of bytes with a row
    for each part and BLOCK windows, and each part is added up by itself: there is no row for each window in the shuffle.
    """
    ship(reads.sparkSession)

    def found(batches):
        for batch in slices(batches):
            for bases, *_ in slabs(batch.column("seq"), k):
                ahead, back, good = rolled(bases, k)
                yield np.minimum(ahead, back)[good]

    def dense(batches):
        total = np.zeros(4**k, np.int64)
        for codes in found(batches):
            codes, n = np.unique(codes, return_counts=True)
            total[codes] += n
        codes = np.flatnonzero(total)
        yield from tables(codes, total[codes])

    if 4**k <= DENSE:
        return reads.select("seq").mapInArrow(dense, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)

    def runs(codes: list[np.ndarray]):
        codes, n = np.unique(np.concatenate(codes), return_counts=True)
        part = ((codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PARTS.bit_length() + 1)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        codes, n, part = codes[order], n[order], part[order]
        starts = np.flatnonzero(np.concatenate((part[:1] >= 0, part[1:] != part[:-1])))
        bounds = np.append(starts, len(part)).astype(np.int32)
        column = lambda x: pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds * 8), pa.py_buffer(x.astype(np.int64))])
        return pa.RecordBatch.from_arrays([pa.array(part[starts]), column(codes), column(n)], ["part", "codes", "counts"])

    def deal(batches):
        held, size = [], 0
        for codes in found(batches):
            held.append(codes)
            size += len(codes)
            if size >= BLOCK:
                yield runs(held)
                held, size = [], 0
        if size:
            yield runs(held)

    def add(batches):
        at, held, size = None, [], 0

        def whole():
            return added(*(np.concatenate(x) for x in zip(*held, strict=True)))

        def done():
            codes, n = whole()
            yield from tables(codes[n >= least], n[n >= least])

        for batch in batches:
            for part, codes, n in zip(*(batch.column(x) for x in ("part", "codes", "counts")), strict=True):
                if part.as_py() != at:
                    if held:
                        yield from done()
                    at, held, size = part.as_py(), [], 0
                held.append(tuple(np.frombuffer(bytes(x.as_buffer()), np.int64) for x in (codes, n)))
                size += len(held[-1][0])
                if len(held) > 1 and size > 2 * max(BLOCK, len(held[0][0])):
                    held = [whole()]
                    size = len(held[0][0])
        if held:
            yield from done()

    dealt = reads.select("seq").mapInArrow(deal, "part int, codes binary, counts binary").repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(add, "code long, n long")


def packed_offsets(reads: DataFrame, k: int) -> DataFrame:
    """(read_id, offset, code, same): canonical k-mers of up to PACKED bases as numbers, and whether the read has them in canonical form."""
    ship(reads.sparkSession)
    given = reads.select("read_id", "seq")

    def run(batches):
        for batch in slices(batches):
            for bases, who, starts, first in slabs(batch.column("seq"), k):
                ahead, back, good = rolled(bases, k)
                at = np.flatnonzero(good)
                starts = np.array(starts)
                read = np.searchsorted(starts, at, "right") - 1
                offset = at - starts[read] + np.where(read == 0, first, 0)
                ids = batch.column("read_id").take(pa.array(np.array(who)[read]))
                ahead, back = ahead[at], back[at]
                yield pa.RecordBatch.from_arrays([ids, pa.array(offset.astype(np.int32)), pa.array(np.minimum(ahead, back)), pa.array(ahead <= back)], ["read_id", "offset", "code", "same"])

    return given.mapInArrow(run, f"read_id {given.schema['read_id'].dataType.simpleString()}, offset int, code long, same boolean")


def canonical_counts(reads: DataFrame, k: int, least: int = 1) -> DataFrame:
    """(kmer, n): canonical k-mers and how often they occur on either strand, `least` times at least. Equal windows are added up before the reverse complement is taken (if they are strings) and again before the shuffle."""
    if k <= PACKED:
        return packed_counts(reads, k, least).select(S.unpack(F.col("code"), k).alias("kmer"), "n")
    forward = kmers(reads, k).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
    return abundant(forward.groupBy(S.canonical(F.col("kmer")).alias("kmer")).agg(F.sum("n").alias("n")), least)


def abundant(counts: DataFrame, least: int) -> DataFrame:
    return counts.filter(F.col("n") >= least)


def spectrum(counts: DataFrame) -> DataFrame:
    """(n, kmers): how many k-mers occur n times."""
    return counts.groupBy("n").agg(F.count(F.lit(1)).alias("kmers"))


def arcs_of_kmers(reads: DataFrame, k: int, least: int = 1) -> DataFrame:
    """(src, dst, cov): canonical k-mers joined by (k+1)-mers that occur at least `least` times; src and dst as read on the canonical (k+1)-mer."""
    longer = canonical_counts(reads, k + 1, least)
    return longer.select(F.expr(f"substring(kmer, 1, {k})").alias("src"), F.expr(f"substring(kmer, 2, {k})").alias("dst"), F.col("n").alias("cov"))


def kmer_graph(reads: DataFrame, k: int, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, seq, cov, counts, arc_counts) and arcs (src, dst, cov) with a node for each abundant canonical k-mer; ids are dense and follow the k-mer's order."""
    from strandloom.operators.graph import numbered
    from strandloom.plans.tables import stored

    found = stored(canonical_counts(reads, k, least), "kmers")
    nodes = stored(numbered(found, "kmer", "node_id"), "numbered")
    ids = nodes.select(F.col("kmer"), F.col("node_id"))
    signed = lambda side: F.when(S.canonical(F.col(side)) == F.col(side), F.col(f"{side}_id")).otherwise(-F.col(f"{side}_id"))
    longer = stored(arcs_of_kmers(reads, k, least), "longer")  # else a join's test for nulls spells out every window before they are added up
    arcs = longer.withColumn("src_c", S.canonical(F.col("src"))).withColumn("dst_c", S.canonical(F.col("dst")))
    for side in ("src", "dst"):
        arcs = arcs.join(ids.select(F.col("kmer").alias(f"{side}_c"), F.col("node_id").alias(f"{side}_id")), f"{side}_c")
    arcs = arcs.select(S.edge(signed("src"), signed("dst")).alias("edge"), "cov").groupBy("edge").agg(F.sum("cov").cast("double").alias("cov")).select("edge.*", "cov")
    nodes = nodes.select("node_id", F.col("kmer").alias("seq"), F.col("n").cast("double").alias("cov"), F.array(F.col("n")).alias("counts"), F.array().cast("array<bigint>").alias("arc_counts"))
    return nodes, arcs


def unitigs(reads: DataFrame, k: int, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """The compacted graph of the abundant k-mers of reads."""
    from strandloom.operators.graph import concatenate

    return concatenate(*kmer_graph(reads, k, least), k)
