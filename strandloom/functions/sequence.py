"""Column expressions over nucleotide sequences, node chains and quality strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Highest Phred score that has a character of its own.
TOP_SCORE = 40


def revcomp(seq: Column) -> Column:
    """Reverse complement; letters other than ACGT are only reversed."""
    return F.translate(F.reverse(seq), "ACGT", "TGCA")


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(kmer, revcomp(kmer))


def windows(seq: Column, k: int) -> Column:
    """All windows of k letters of ACGT in order, as an array. One pass over the sequence: a lookahead matches at every
    place, so that no substring is found by walking from the start. Sequences shorter than k and windows with any
    other letter give nothing."""
    return F.regexp_extract_all(seq, F.lit(f"(?=([ACGT]{{{k}}}))"), F.lit(1))


def all_windows(seq: Column, k: int) -> Column:
    """All windows of k characters in order, whatever they are: the index of a window is its offset."""
    return F.regexp_extract_all(seq, F.lit(f"(?=(.{{{k}}}))"), F.lit(1))


def is_acgt(seq: Column) -> Column:
    return seq.rlike("^[ACGT]+$")


def pack(kmer: Column) -> Column:
    """A k-mer of up to 31 bases as a number of 2 bits a base, A0 C1 G2 T3."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def unpack(number: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(number.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def oriented(seq: Column, node: Column) -> Column:
    """The sequence of a signed node."""
    return F.when(node < 0, revcomp(seq)).otherwise(seq)


def base_at(seq: Column, node: Column, pos: Column) -> Column:
    """The nucleotide at an offset of a signed node, '-' outside it."""
    found = F.substring(oriented(seq, node), pos + 1, F.lit(1))
    return F.when((pos < 0) | (pos >= F.length(seq)), F.lit("-")).otherwise(found)


def marginal_length(seq: Column, k: int) -> Column:
    """Number of k-mers of a node."""
    return F.length(seq) - k + 1


def wrap(seq: Column, width: int = 60) -> Column:
    return F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", "")


def edge(src: Column, dst: Column) -> Column:
    """The canonical form of an edge and its mirror image."""
    return F.when(src < -dst, F.struct(src.alias("src"), dst.alias("dst"))).otherwise(F.struct((-dst).alias("src"), (-src).alias("dst")))


def chain_revcomp(chain: Column) -> Column:
    return F.transform(F.reverse(chain), lambda i: -i)


def chain_canonical(chain: Column) -> Column:
    return F.least(chain, chain_revcomp(chain))


def glue(seqs: Column, k: int) -> Column:
    """The sequence of nodes that overlap by k - 1: the first whole, the others from their k-th base."""
    return F.array_join(F.transform(seqs, lambda s, i: F.when(i == 0, s).otherwise(F.substring(s, F.lit(k), F.lit(1 << 30)))), "")


def phred_correct(score: Column) -> Column:
    """The probability that a base of this score is right; scores below 0 count as sure."""
    return F.when(score < 0, F.lit(1.0)).otherwise(1 - F.pow(F.lit(10.0), -score / 10))


def qual_scores(qual: Column, base: int = 33) -> Column:
    return F.transform(F.regexp_extract_all(qual, F.lit("(?s)(.)"), F.lit(1)), lambda c: F.ascii(c) - base)


def window_correct(scores: Column, start: Column, k: Column) -> Column:
    """The probability that all bases of a window are right."""
    return F.aggregate(F.slice(scores, start + 1, k), F.lit(1.0), lambda acc, q: acc * phred_correct(q))


def phred_char(p: Column, base: int = 33) -> Column:
    """The character of an error probability: at most 40, rounded down; 0 gives the highest."""
    score = F.when(p <= 0, F.lit(TOP_SCORE)).otherwise(F.least(F.lit(TOP_SCORE), F.floor(-10 * F.log10(p)).cast("int")))
    return F.char(F.greatest(score, F.lit(0)) + base)
