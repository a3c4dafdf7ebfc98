"""Near copies by operator 1's method: all components that pairs with a Jaccard similarity of LEAST or more of their sets of five-word shingles make, and no other.

SimHash as in `simhash`, with a longer fingerprint: the hashes of a text's shingles are folded into BITS sums, and a bit is
set where over half of the hashes have it. At a similarity of 0.8 two fingerprints differ in about 0.15 of the bits, other
texts in about half. Bit blocks: KEYS choices of blocks of a width that follows the number of texts are the join keys of
distinct sets; equal ones are never paired. Verification: the Hamming distance of candidates is at most DISTANCE, and
then their whole sets are compared, so that a link is never an estimate.

Blocks of bits find a pair with a probability, not for certain, and in large buckets texts are only held against one of
them. The rest is exact: with all shingles in one order, those of more than BUCKET_PAIRS texts last and by how many have
them, then by hash, two sets of n and m shingles that are similar share one of the first n // 5 + 1 and m // 5 + 1. All
shingles of all texts are counted for that: those that a sample takes for rare make blocks of texts that are no near copies.
Each shingle of the first is a block, from which pairs are taken only across the components that SimHash has found.
Candidates need sizes and places of the common shingle that leave room for enough others. In a block of up to BUCKET_PAIRS
texts every such pair is a candidate. Texts of larger blocks are held against a few pivots first, in rounds, and at last
against all those that are not in their component yet: no pair that could join two components is left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm import common
from strandloom.llm.components import connected_components
from strandloom.llm.fingerprints import BASE, SHIFTS, WORDS, mixed, word_hashes
from strandloom.session import ship

#: The least similarity of near copies, as a fraction.
LEAST = (4, 5)
#: Bits of a fingerprint, the most by which near copies differ (0.15 of them are expected at a similarity of 0.8, with a standard deviation of 0.016), choices of blocks, and the seed that lays the blocks.
BITS, DISTANCE, KEYS, SEED = 512, 160, 64, 42
#: A choice of blocks has this many bits more than the number of texts has.
SPARE = 4
#: In larger blocks, texts are held against PIVOTS of them first and against four times as many in each round, until the pairs across components are no more than CROSSING for each text or go down by less than a fourth.
BUCKET_PAIRS, PIVOTS, CROSSING = 4, 4, 2
#: Counts of a sketch: one for each leading byte. Up to so many hashes of texts are broadcast (8 bytes each).
FOLDS, BROADCAST = 256, 1_000_000
#: A task counts about as many shingles as SAMPLE texts have at most; the FREQUENT most frequent are known. Both change the work, never the result.
SAMPLE, FREQUENT = 2_000, 1_000_000


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles of a text as sorted hashes; a text of fewer words than a shingle has is one shingle of all of them."""
    _, words = word_hashes(np.frombuffer((text or "").encode().lower(), np.uint8))
    if len(words) >= WORDS:
        return np.unique(mixed(sum(words[k : len(words) - WORDS + 1 + k] * SHIFTS[k] for k in range(WORDS))))
    return mixed(np.array([sum(int(w) * int(s) for w, s in zip(words, SHIFTS, strict=False)) % (1 << 64) ^ len(words)], np.uint64))


def folded(hashes: np.ndarray) -> bytes:
    """The fingerprint of a set: its bit i is set if over half of the hashes, mixed anew for every 64 bits, have it."""
    turns = np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(BASE)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 255):  # sums of so many fit in a byte
        ones += np.unpackbits(mixed(hashes[at : at + 255, None] + turns).astype(">u8").view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def choices(texts: int) -> list[np.ndarray]:
    """The bits of each choice of blocks, for so many texts; disjoint until all bits are used, then in another order."""
    width, draw, found = max(8, min(40, texts.bit_length() + SPARE)), np.random.default_rng(SEED), []
    while len(found) < KEYS:
        order = draw.permutation(BITS)
        found += [order[k : k + width] for k in range(0, BITS - width + 1, width)]
    return found[:KEYS]


def frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """The keys, sorted, and numbers of documents of the shingles that more than BUCKET_PAIRS of docs (same, text) have, and by how many bits a hash is moved to be its key.

    All shingles are counted: 32 bits of each go to the range that the bits before them tell, so that tasks stay small
    and a key almost always has one shingle only.
    """
    depth = min(31, (docs.count() // SAMPLE).bit_length())
    left = 32 - depth

    def packed(batches):
        for batch in common.sliced(batches):
            if len(batch):
                keys = np.sort(np.concatenate([shingles(text) for text in batch.column("text").to_pylist()]) >> np.uint64(left))
                ranges, starts = np.unique(keys >> np.uint64(32), return_index=True)
                offsets = (4 * np.append(starts, len(keys))).astype(np.int32)
                parts = pa.Array.from_buffers(pa.binary(), len(ranges), [None, pa.py_buffer(offsets), pa.py_buffer(keys.astype(np.uint32))])
                yield pa.RecordBatch.from_arrays([pa.array(ranges.astype(np.int64)), parts], ["range", "keys"])

    def counted(table):
        keys, n = np.unique(np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint32), return_counts=True)
        most = n > BUCKET_PAIRS
        first = table.column("range")[0].as_py() << 32
        return pa.table({"key": pa.array(first + keys[most].astype(np.int64)), "n": pa.array(n[most].astype(np.int64))})

    found = docs.select("text").mapInArrow(packed, "range long, keys binary").groupBy("range").applyInArrow(counted, "key long, n long")
    found = common.stored(found, "frequent")
    total, least = 0, None
    for n, keys in found.groupBy("n").agg(F.count(F.lit(1))).orderBy(F.desc("n")).collect():
        total += keys
        if total > FREQUENT:
            break
        least = n
    some = found.filter(F.col("n") >= F.lit(least)).toArrow()  # none if there is no least number
    common.forget(found)
    known, counts = some.column("key").to_numpy().astype(np.uint64), some.column("n").to_numpy().astype(np.int32)
    order = np.argsort(known)
    return known[order], counts[order], left


def prefix(hashes: np.ndarray, known: np.ndarray, counts: np.ndarray, left: int) -> np.ndarray:
    """Those shingles of a set, in the order of all, of which a similar set has one too."""
    if len(known):
        keys = hashes >> np.uint64(left)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hashes = hashes[np.argsort(np.where(known[at] == keys, counts[at], 0), kind="stable")]
    p, q = LEAST
    return hashes[: len(hashes) - -(-len(hashes) * p // q) + 1]


def room(a: F.Column, b: F.Column) -> F.Column:
    """Whether two texts (same, n, place) that share the shingle at these places can have enough in common from there on; each similar pair passes at the first shingle that it shares."""
    p, q = LEAST
    return (p + q) * F.least(a["n"] - a["place"], b["n"] - b["place"]) >= p * (a["n"] + b["n"])


def crowded(rows: DataFrame, key: str) -> DataFrame:
    """rows with the number of those that share their key, where others do."""
    return rows.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy(key))).filter("size > 1")


def needed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of docs that are in a pair (a, b)."""
    some = common.stored(pairs.select(F.col("a").alias("same")).union(pairs.select("b")).distinct(), "needed")
    return docs.join(F.broadcast(some) if some.count() <= BROADCAST else some, "same", "left_semi")


def simhashed(docs: DataFrame) -> DataFrame:
    """Pairs (a, b) of docs (same, text) that SimHash finds and whose sets are similar, as a stored table."""

    def run(batches):
        for batch in common.sliced(batches):
            sets = [shingles(text) for text in batch.column("text").to_pylist()]
            wholes = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("same"), pa.array(wholes, pa.int64()), pa.array(list(map(folded, sets)), pa.binary())], ["same", "whole", "fp"])

    prints = common.stored(docs.mapInArrow(run, "same long, whole long, fp binary").dropDuplicates(["same"]), "prints")
    firsts = prints.groupBy("whole").agg(F.min("same").alias("first"))
    rooted = common.stored(prints.join(firsts, "whole").select("same", "first", "fp"), "firsts")
    copies = rooted.filter("same <> first").select(F.col("first").alias("a"), F.col("same").alias("b"))
    common.forget(prints)
    prints = rooted.filter("same = first").select("same", "fp")
    blocks = choices(prints.count())

    def keyed(batches):
        for batch in common.sliced(batches, BITS * 256):
            bits = np.unpackbits(np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint8).reshape(-1, BITS // 8), axis=1)
            for k, at in enumerate(blocks):
                buckets = bits[:, at].astype(np.int64) @ (1 << np.arange(len(at), dtype=np.int64)) + (k << 40)
                yield pa.RecordBatch.from_arrays([pa.array(buckets), batch.column("same")], ["bucket", "same"])

    def close(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, BITS // 64) for c in ("xs", "ys"))
            yield batch.select(["a", "b"]).filter(pa.array(np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= DISTANCE))

    met = common.stored(crowded(prints.mapInArrow(keyed, "bucket long, same long"), "bucket"), "met")
    x, y = met.filter(F.col("size") <= BUCKET_PAIRS).alias("x"), met.alias("y")
    small = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.same") < F.col("y.same"))).select(F.col("x.same").alias("a"), F.col("y.same").alias("b"))
    crowd = met.filter(F.col("size") > BUCKET_PAIRS)
    first = crowd.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("bucket", "same").alias("nth"), F.col("same").alias("first")))["first"].alias("first"))
    stars = crowd.join(first, "bucket").filter("same <> first").select(F.least("same", "first").alias("a"), F.greatest("same", "first").alias("b"))
    pairs = common.stored(small.union(stars).distinct(), "pairs")
    side = lambda x, s: prints.select(F.col("same").alias(x), F.col("fp").alias(s))
    candidates = common.stored(pairs.join(side("a", "xs"), "a").join(side("b", "ys"), "b").select("a", "b", "xs", "ys").mapInArrow(close, "a long, b long"), "candidates")
    found = common.stored(similar(candidates, docs).union(copies), "simhashed")
    common.forget(rooted, met, pairs, candidates)
    common.swept(docs.sparkSession)
    return found


def similar(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar."""

    def listed(batches):
        for batch in common.sliced(batches):
            sets = [shingles(text).view(np.int64) for text in batch.column("text").to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("same"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))], ["same", "shingles"])

    p, q = LEAST
    sets = common.stored(needed(candidates, docs).mapInArrow(listed, "same long, shingles array<long>").dropDuplicates(["same"]), "shingles")
    both = candidates.join(sets.select(F.col("same").alias("a"), F.col("shingles").alias("xs")), "a").join(sets.select(F.col("same").alias("b"), F.col("shingles").alias("ys")), "b")
    found = common.stored(both.filter((p + q) * F.size(F.array_intersect("xs", "ys")) >= p * (F.size("xs") + F.size("ys"))).select("a", "b"), "near")
    common.forget(sets)
    return found


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of texts whose sets are similar, as a stored table.

    Most others are ruled out by sketches first: FOLDS counts of shingles by the leading bits of their hashes. The counts'
    differences add up to no more than the number of shingles that only one has, so that no similar pair is lost.
    """

    def sketched(batches):
        for batch in common.sliced(batches):
            sets = [shingles(text) for text in batch.column("text").to_pylist()]
            counts = [np.minimum(np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=FOLDS), 255).astype(np.uint8).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("same"), pa.array(list(map(len, sets)), pa.int64()), pa.array(counts, pa.binary())], ["same", "n", "sketch"])

    def close(batches):
        for batch in batches:
            xs, ys = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, FOLDS).astype(np.int16) for c in ("xs", "ys"))
            apart = np.abs(xs - ys).sum(1, dtype=np.int64)
            p, q = LEAST
            keep = (p + q) * apart <= (q - p) * (batch.column("na").to_numpy() + batch.column("nb").to_numpy())
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    pairs = common.stored(pairs.distinct(), "pairs")
    sketches = common.stored(needed(pairs, docs).mapInArrow(sketched, "same long, n long, sketch binary").dropDuplicates(["same"]), "sketches")
    side = lambda x, n, s: sketches.select(F.col("same").alias(x), F.col("n").alias(n), F.col("sketch").alias(s))
    candidates = common.stored(pairs.join(side("a", "na", "xs"), "a").join(side("b", "nb", "ys"), "b").select("a", "b", "na", "nb", "xs", "ys").mapInArrow(close, "a long, b long"), "candidates")
    found = similar(candidates, docs)
    common.forget(pairs, sketches, candidates)
    common.swept(docs.sparkSession)
    return found


def links(docs: DataFrame) -> DataFrame:
    """Pairs (a, b) of docs (same, text), among them enough of the similar ones that all similar texts are in one component, and only similar ones."""
    found = simhashed(docs)
    return found.union(rest(docs, found))


def rest(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Those pairs of `links` that join components of the pairs found, by the shingles that similar sets share."""
    known, counts, left = frequent(docs)

    def run(batches):
        for batch in common.sliced(batches):
            sames, keys, sizes, places = [], [], [], []
            for same, text in zip(batch.column("same").to_pylist(), batch.column("text").to_pylist(), strict=True):
                hashes = shingles(text)
                some = prefix(hashes, known, counts, left)
                sames.append(np.full(len(some), same, np.int64))
                keys.append(some.view(np.int64))
                sizes.append(np.full(len(some), len(hashes), np.int32))
                places.append(np.arange(len(some), dtype=np.int32))
            if sames:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, sames, sizes, places)], ["shingle", "same", "n", "place"])

    keys = docs.mapInArrow(run, "shingle long, same long, n int, place int")
    met = common.stored(crowded(keys, "shingle"), "met")  # few of all keys
    common.swept(docs.sparkSession)
    member = F.xxhash64("same")
    blocks = common.stored(met.drop("size").distinct(), "blocks")  # repeated rows aside
    signs = blocks.groupBy("shingle").agg(F.bit_xor(member).alias("s1"), F.bit_xor(F.xxhash64(member)).alias("s2"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    # blocks of the same texts are one, with the first place of each text
    buckets = blocks.join(signs, "shingle").groupBy(F.xxhash64("s1", "s2", "size").alias("shingle"), "same").agg(F.min("n").alias("n"), F.min("place").alias("place"))
    roots = connected_components(found).select(F.col("node").alias("same"), "root")
    buckets = crowded(buckets, "shingle").join(roots, "same", "left").withColumn("root", F.coalesce("root", "same"))
    buckets = common.stored(buckets, "buckets")
    common.forget(met, blocks)
    common.swept(docs.sparkSession)
    near = lambda x, y: (y["same"] > x["same"]) & (y["root"] != x["root"]) & room(x, y)
    pairs = F.flatten(F.transform("texts", lambda x: F.transform(F.filter("texts", lambda y: near(x, y)), lambda y: F.struct(x["same"].alias("a"), y["same"].alias("b")))))
    small = buckets.filter(F.col("size") <= BUCKET_PAIRS).groupBy("shingle").agg(F.collect_list(F.struct("same", "n", "place", "root")).alias("texts"))
    small = small.select(F.explode(pairs).alias("pair")).select("pair.a", "pair.b")
    large = common.stored(buckets.filter(F.col("size") > BUCKET_PAIRS), "large")
    more = verified(small.union(pivoted(large, 0)), docs)
    if large.isEmpty():
        return more
    turn, before = 0, float("inf")
    while True:
        large = large.filter(F.col("size") > PIVOTS * 4**turn)  # of smaller blocks all texts have been pivots
        roots = connected_components(found.union(more)).select(F.col("node").alias("same"), "root")
        texts = common.stored(large.drop("root").join(roots, "same", "left").withColumn("root", F.coalesce("root", "same")), "texts")
        sizes = texts.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("shingle").agg(F.count(F.lit(1)).alias("roots"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("within"))
        sizes = common.stored(sizes.filter("roots > 1"), "crossing")
        crossing = sizes.agg(F.sum("n").alias("n"), F.sum((F.col("n") * F.col("n") - F.col("within")) / 2).alias("pairs")).first()
        if not crossing.n:
            return more
        texts = common.stored(texts.join(sizes.select("shingle"), "shingle", "left_semi"), "apart")
        if crossing.pairs <= CROSSING * crossing.n or turn > 1 and 4 * crossing.pairs > 3 * before:
            break
        turn, before = turn + 1, crossing.pairs
        more = more.union(verified(pivoted(texts, turn), docs))
    x, y = texts.alias("x"), texts.alias("y")
    fits = room({c: F.col(f"x.{c}") for c in ("n", "place")}, {c: F.col(f"y.{c}") for c in ("n", "place")})
    apart = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.same") < F.col("y.same")) & (F.col("x.root") != F.col("y.root")) & fits)
    return more.union(verified(apart.select(F.col("x.same").alias("a"), F.col("y.same").alias("b")), docs))


def pivoted(texts: DataFrame, turn: int) -> DataFrame:
    """Candidate pairs (a, b) of a few of each block's texts, those of least hash and so the same ones in all blocks where they are, and its texts of other components."""
    least = Window.partitionBy("shingle").orderBy(F.xxhash64(F.lit(turn), "same"))
    pivots = texts.withColumn("nth", F.row_number().over(least)).filter(F.col("nth") <= PIVOTS * 4**turn).drop("nth")
    x, y = pivots.alias("x"), texts.alias("y")
    fits = room({c: F.col(f"x.{c}") for c in ("n", "place")}, {c: F.col(f"y.{c}") for c in ("n", "place")})
    met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.root") != F.col("y.root")) & fits)
    return met.select(F.least("x.same", "y.same").alias("a"), F.greatest("x.same", "y.same").alias("b"))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component of near copies: the one of smallest identifier. Rows that repeat its identifier and text are left out too; other columns are unchanged.

    Letters of ASCII count as small, white space only ends words. Null counts as empty; texts without words are near
    copies of each other. Null identifiers stay only if there is no other. Texts of any length are read whole.
    An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("same"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = common.stored(texts.select("doc_id", "same"), "rows")
    roots = connected_components(links(texts.select("same", "text"))).select(F.col("node").alias("same"), "root")
    rooted = rows.join(roots, "same", "left").withColumn("root", F.coalesce("root", "same"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "same"))
    stay = rooted.groupBy("root").agg(least.alias("least")).select(F.col("least.doc_id").alias("doc_id"), F.col("least.same").alias("same"))
    n = rows.groupBy(F.col("doc_id").alias("id"), F.col("same").alias("hash")).agg(F.count(F.lit(1)).alias("n"))
    stay = stay.join(n, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("same") == F.col("hash"))).select("doc_id", "same", "n")
    return common.chosen(docs, common.stored(stay, "stay"), id_col, text_col)
