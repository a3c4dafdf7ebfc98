"""Document fingerprints by one-permutation MinHash.

The hashes of a text's shingles are put in BINS bins by their leading bits, once, and each bin keeps its least hash. An
empty bin takes the value of another, chosen by a sequence of hashes of its own number that ends at the first bin that
is not empty (optimal densification). Of each bin the lowest BIN_BITS bits are packed. Two fingerprints agree by chance
in one bin of 2 ** BIN_BITS, for which the likeness is corrected.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from strandloom.llm import common
from strandloom.session import ship

BINS, BIN_BITS, WORDS = 256, 4, 5
#: Bytes whose words are hashed at once.
SLAB = 1 << 20
#: Runs of neighbouring documents that a task gets, about.
RUNS = 4

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
BASE = 0x9E3779B97F4A7C15 | 1
SHIFTS = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(WORDS)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64 for i below n."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


_blank = np.zeros(256, bool)
_blank[[32, *range(9, 14)]] = True


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The starts of the words in a text's bytes, and their hashes."""
    edge = np.diff(np.concatenate(([True], _blank[data], [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = powers(len(data) + 1)
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)))
    return starts, mixed((upto[ends] - upto[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def binned(texts: list[bytes]) -> np.ndarray:
    """The least hash of each text's bins; EMPTY where there is none."""
    bins = np.full((len(texts), BINS), EMPTY)
    some, size = [], 0
    for k, text in enumerate(texts):
        if len(text) > SLAB:
            _long(text, bins[k])
            continue
        some.append(k)
        size += len(text) + 1
        if size > SLAB:
            _short(texts, some, bins)
            some, size = [], 0
    if some:
        _short(texts, some, bins)
    return bins


def _short(texts: list[bytes], some: list[int], bins: np.ndarray) -> None:
    data = np.frombuffer(b" ".join(texts[k] for k in some), np.uint8)
    starts, words = word_hashes(data)
    ends = np.cumsum([len(texts[k]) + 1 for k in some])
    doc = np.searchsorted(ends, starts, "right")
    count = np.bincount(doc, minlength=len(some))
    if len(words) >= WORDS:
        hashes = mixed(sum(words[k : len(words) - WORDS + 1 + k] * SHIFTS[k] for k in range(WORDS)))
        inside = doc[: len(hashes)] == doc[WORDS - 1 :]
        _least(bins, np.asarray(some)[doc[: len(hashes)][inside]], hashes[inside])
    first = np.cumsum(count) - count
    few = np.flatnonzero(count < WORDS)  # one shingle of all words
    hashes = np.array([sum((int(w) * int(s) for w, s in zip(words[a : a + n], SHIFTS, strict=False)), 0) % (1 << 64) ^ int(n) for a, n in zip(first[few], count[few], strict=True)], np.uint64)
    _least(bins, np.asarray(some)[few], mixed(hashes))


def _long(text: bytes, bins: np.ndarray) -> None:
    from strandloom.llm.simhash import slabs

    rest, any_ = b"", False
    for slab in slabs(text):
        data = np.frombuffer(rest + slab, np.uint8)
        starts, words = word_hashes(data)
        if len(words) >= WORDS:
            any_ = True
            hashes = mixed(sum(words[k : len(words) - WORDS + 1 + k] * SHIFTS[k] for k in range(WORDS)))
            _least(bins[None], np.zeros(len(hashes), np.int64), hashes)
            rest = bytes(data[starts[len(starts) - WORDS + 1] :])
        else:
            rest = bytes(data)
    if not any_:
        one = np.full((1, BINS), EMPTY)
        _short([rest], [0], one)
        bins[:] = one[0]


def _least(bins: np.ndarray, doc: np.ndarray, hashes: np.ndarray) -> None:
    np.minimum.at(bins.reshape(-1), doc * BINS + (hashes >> np.uint64(56)).astype(np.int64), hashes)


def densified(bins: np.ndarray) -> np.ndarray:
    """bins with every empty bin filled; each text has at least one that is not."""
    filled = bins.copy()
    doc, place = np.nonzero(bins == EMPTY)
    tries = np.uint64(0)
    while len(doc):
        tries += np.uint64(1)
        other = (mixed(place.astype(np.uint64) * np.uint64(BASE) + tries) >> np.uint64(40)).astype(np.int64) % BINS
        got = bins[doc, other]
        filled[doc, place] = got
        left = got == EMPTY
        doc, place = doc[left], place[left]
    return filled


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """The lowest bits of each text's bins, one in a byte."""
    if not texts:
        return np.zeros((0, BINS), np.uint8)
    return (densified(binned(texts)) & np.uint64((1 << BIN_BITS) - 1)).astype(np.uint8)


def packed(prints: np.ndarray) -> list[str]:
    """Fingerprints as hexadecimal digits, one for each bin."""
    both = (prints[:, ::2] << 4) | prints[:, 1::2]
    text, width = both.tobytes().hex(), BINS
    return [text[i * width : (i + 1) * width] for i in range(len(prints))]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The estimated share of shingles in common, from 0 to 1."""
    chance = 2.0**-BIN_BITS
    return np.clip(((a == b).mean(1) - chance) / (1 - chance), 0, 1)


def compared(batches):
    """For rows in order, each document against its edited text and the row that follows; rows marked `tail` only follow."""
    carry = []
    for batch in batches:
        rows = carry + list(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("tail").to_pylist(), strict=True))
        at = 0
        while at < len(rows) - 1:
            size, end = 0, at
            while end < len(rows) - 1 and (size < 4 * SLAB or end == at):
                size += len(rows[end][1] or "")
                end += 1
            part = rows[at : end + 1]
            texts = [r[1] or "" for r in part]
            ours = fingerprints([t.encode() for t in texts])
            keep = [i for i in range(len(part) - 1) if not part[i][2]]
            edited = []
            for i in keep:
                n = len(texts[i]) // 4
                edited.append((texts[i][: len(texts[i]) - n] + texts[i + 1][:n]).encode())
            theirs, mine = fingerprints(edited), ours[keep]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part[i][0] for i in keep], pa.int64()),
                    pa.array([len(texts[i]) for i in keep], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in edited], pa.string()),
                    pa.array(packed(mine), pa.string()),
                    pa.array(packed(theirs), pa.string()),
                    pa.array(likeness(mine, theirs), pa.float64()),
                    pa.array(likeness(mine, ours[[i + 1 for i in keep]]), pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )
            at = end
        carry = rows[-1:]


def in_order(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) in runs of neighbouring identifiers: partitioned by `run`, sorted, each run ended by a copy of the row that follows it (tail = 1)."""
    spark = docs.sparkSession
    tasks = common.partitions(spark)
    runs = RUNS * tasks
    found = docs.select(F.percentile_approx("doc_id", [i / runs for i in range(1, runs)], 10 * runs).alias("cuts")).first().cuts or []
    edges = np.unique(np.asarray(found, np.int64))

    @pandas_udf("int")
    def number(ids: pd.Series) -> pd.Series:
        return pd.Series(np.where(ids.isna(), 0, np.searchsorted(edges, ids.fillna(0).astype("int64"), "right")).astype(np.int32))

    firsts = docs.select("doc_id", number("doc_id").alias("run")).groupBy("run").agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("none")).collect()
    firsts = sorted((r.run, None if r.none else r.first) for r in firsts)
    before = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
    ids = [first for first, _ in before if first is not None]
    nulls = [run for first, run in before if first is None]
    known = dict(before)

    @pandas_udf("int")
    def run_before(ids: pd.Series) -> pd.Series:
        return pd.Series([known.get(i) for i in ids], dtype="Int32")

    numbered = docs.select("doc_id", "text", number("doc_id").alias("run"), F.lit(0).alias("tail"))
    tails = docs.filter(F.col("doc_id").isin(ids)).select("doc_id", "text", run_before("doc_id").alias("run"), F.lit(1).alias("tail"))
    if nulls:
        tails = tails.union(docs.filter("doc_id IS NULL").orderBy("text").limit(1).select("doc_id", "text", F.lit(nulls[0]).alias("run"), F.lit(1).alias("tail")))
    return numbered.union(tails).repartition(tasks, "run").sortWithinPartitions("run", "tail", F.col("doc_id").asc_nulls_first(), "text")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text ends in the head of the next document's text, in ascending order of identifier (nulls first; rows
    of one identifier by text; after the last comes the first). Null counts as empty. A text of fewer words than a
    shingle has is one shingle of all of them, a text without words a shingle of none. Equal texts have equal
    fingerprints. A table of one row is next to itself; an empty table gives an empty result. Other columns of docs
    are not read.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return in_order(docs).select("doc_id", "text", "tail").mapInArrow(compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
