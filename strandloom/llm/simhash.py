"""Near duplicates by SimHash: fingerprints, pigeonhole blocks, verified Hamming distances, components.

A pair at a distance of at most d agrees on at least BLOCKS - d of BLOCKS bit blocks, so it meets in the bucket of some
choice of that many blocks. Only distinct fingerprints go there: copies are never paired. In a bucket of up to
BUCKET_PAIRS fingerprints each pair is verified. Fingerprints of larger buckets are linked by points instead: two
fingerprints are at most 2 bits apart exactly if some point is at most 1 bit from both, and a point has at most 65
fingerprints around it, so that no group is large and no pair is lost.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import common
from strandloom.llm.components import connected_components

#: Bit blocks of a fingerprint; the most bits by which linked ones differ.
BLOCKS, DISTANCE = 5, 2
#: Words in a shingle; seed of its hash.
WORDS, SEED = 3, 42
#: Larger buckets are linked by points.
BUCKET_PAIRS = 128
#: Bytes of a text that are split at once.
SLAB = 1 << 20

BLANK = re.compile(rb"[\x20\x09-\x0D]")


def slabs(data: bytes):
    """data in pieces that end at white space."""
    at = 0
    while len(data) - at > SLAB and (m := BLANK.search(data, at + SLAB)):
        yield data[at : m.end()]
        at = m.end()
    yield data[at:] if at else data


def simhash(text: str | None, words: int = WORDS) -> int:
    """The fingerprint of a text as a signed 64-bit number; 0 if it has no words."""
    data, ones, n, rest, digest = (text or "").encode().lower(), np.zeros(64, np.int64), 0, [], xxhash.xxh64_intdigest
    for slab in slabs(data):
        rest += slab.split()
        if len(rest) < words:
            continue
        joined, ends = b" ".join(rest), np.cumsum(np.fromiter(map(len, rest), np.int64, len(rest)) + 1) - 1
        starts = np.concatenate(([0], ends[: len(rest) - words] + 1)).tolist()
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64)
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n += len(hashes)
        rest = rest[len(rest) - words + 1 :] if words > 1 else []
    if not n and rest:
        ones, n = np.unpackbits(np.array([digest(b" ".join(rest), SEED)], ">u8").view(np.uint8)).astype(np.int64), 1
    return int(np.packbits(2 * ones > n).view(">i8")[0]) if n else 0


def fingerprinted(batches):
    for batch in common.sliced(batches):
        prints = [simhash(text) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("same"), pa.array(prints, pa.int64())], ["doc_id", "same", "fp"])


def links(prints: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct fingerprints fp that differ in at most DISTANCE bits; every linked pair is joined by them, directly or (in large buckets) over a third that is linked to both."""
    edges = [round(i * 64 / BLOCKS) for i in range(BLOCKS + 1)]
    whole = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(m) for m in combinations(whole, BLOCKS - DISTANCE)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = prints.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)])).alias("bucket"))
    sizes = common.stored(keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    near = lambda a, b: (b > a) & (F.bit_count(a.bitwiseXOR(b)) <= DISTANCE)
    pairs = F.flatten(F.transform("fps", lambda a: F.transform(F.filter("fps", lambda b: near(a, b)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    small = keys.join(sizes.filter(F.col("n") <= BUCKET_PAIRS), "bucket").groupBy("bucket").agg(F.collect_list("fp").alias("fps")).select(F.explode(pairs).alias("pair")).select("pair.a", "pair.b")
    large = sizes.filter(F.col("n") > BUCKET_PAIRS)
    if large.isEmpty():
        return small.distinct()
    flips = [0] + [(1 << i) - (1 << 64 if i == 63 else 0) for i in range(64)]
    crowd = common.join_counted(keys, large, "bucket", "n", 10 * prints.count()).select("fp").distinct()
    points = crowd.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(x)) for x in flips])).alias("point"))
    stars = points.groupBy("point").agg(F.sort_array(F.collect_list("fp")).alias("fps")).filter("size(fps) > 1").select(F.element_at("fps", 1).alias("a"), F.explode(F.slice("fps", F.lit(2), F.size("fps") - 1)).alias("b"))
    return small.union(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fp (long), same (a hash of the text), component_id and keep_same.

    component_id is the smallest identifier among the documents that links join; (component_id, keep_same) marks its
    row that stays. Null and empty texts have fingerprint 0 and are linked like any other; null identifiers are never
    the smallest but where there is no other. Repeated rows and ties fall in one component. Texts of any length are
    read whole. An empty table gives an empty result. Other columns of docs are not read.
    """
    rows = common.stored(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("same")).mapInArrow(
            fingerprinted, "doc_id long, same long, fp long"
        ),
        "fingerprints",
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "same"))
    prints = common.stored(rows.groupBy("fp").agg(first.alias("first"), F.count(F.lit(1)).alias("n")), "prints")
    roots = connected_components(links(prints)).select(F.col("node").alias("fp"), "root")
    least = prints.join(roots, "fp").groupBy("root").agg(F.min("first").alias("least"))
    found = prints.join(roots.join(least, "root").select("fp", "least"), "fp", "left").select("fp", "n", F.coalesce("least", "first").alias("least"))
    found = common.stored(found, "components")
    return common.join_counted(rows, found, "fp", "n", rows.count()).select("doc_id", "fp", "same", F.col("least.doc_id").alias("component_id"), F.col("least.same").alias("keep_same"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sets: bool = False) -> DataFrame:
    """docs with one row of each component: the one of smallest identifier. Rows that repeat its identifier and text are left out too; other columns are unchanged, whatever their names.

    Components are those of `near_duplicates`, or with `sets` those of texts whose sets of five-word shingles have a
    Jaccard similarity of 0.8 or more, found by longer fingerprints, as 64 bits are too few for that (see `nearcopies`).
    Nulls, empty and very long texts and ties are treated as there; an empty table gives an empty result.
    """
    if sets:
        from strandloom.llm import nearcopies

        return nearcopies.without_near_copies(docs, id_col, text_col)
    found = near_duplicates(docs, id_col, text_col)
    stay = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("same") == F.col("keep_same"))).groupBy("doc_id", "same").agg(F.count(F.lit(1)).alias("n"))
    return common.chosen(docs, common.stored(stay, "stay"), id_col, text_col)
