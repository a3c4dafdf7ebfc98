"""Exact duplicates by a tree merge of sorted digest runs.

Every document becomes a digest row. Rows with one owner (a hash of the row) form that owner's run: one entry for each
digest, in order, with its retained identifier and its number of rows. A run is one value of packed records. Then owners
exchange runs in rounds: in round r the owners that share all but the r lowest octal digits send theirs to the lowest of
them, which merges up to FAN sorted runs two by two, without sorting again, keeps the retained identifier of every
digest and verifies, as the first runs did, that entries of one digest agree on length and a second hash. Runs are cut
into segments by that second hash, so no merge holds more than a segment, and the number of segments follows the number
of rows. Copies are counted before the first runs are made, so a hot text is one row per owner.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import common

#: Runs that one merge takes, and rounds; FAN ** ROUNDS owners hold the first runs.
FAN, ROUNDS = 8, 2
#: Digest rows in a segment, about.
SEGMENT_ROWS = 100_000

#: An entry of a run.
ENTRY = np.dtype([("digest", "S32"), ("none", "u1"), ("id", "<i8"), ("row", "<i8"), ("n", "<i8"), ("n_bytes", "<i8"), ("check", "<i8")])
RUN = "segment int, owner int, run binary"


def better(a: np.ndarray, b: np.ndarray, keep: str) -> np.ndarray:
    """Where the identifiers of a are retained rather than those of b: null only if there is no other, ties by row."""
    if keep == "largest":
        lesser = (a["id"] > b["id"]) | (a["id"] == b["id"]) & (a["row"] > b["row"])
    else:
        lesser = (a["id"] < b["id"]) | (a["id"] == b["id"]) & (a["row"] < b["row"])
    return (a["none"] < b["none"]) | (a["none"] == b["none"]) & lesser


def merged(a: np.ndarray, b: np.ndarray, keep: str) -> np.ndarray:
    """The sorted run of two sorted runs."""
    place = np.searchsorted(a["digest"], b["digest"])
    both = np.zeros(len(b), bool)
    inside = place < len(a)
    both[inside] = a["digest"][place[inside]] == b["digest"][inside]
    ours, theirs = a[place[both]], b[both]
    if (ours["n_bytes"] != theirs["n_bytes"]).any() or (ours["check"] != theirs["check"]).any():
        raise ValueError("two different texts have one SHA-256 digest")
    one = np.where(better(ours, theirs, keep), ours, theirs)
    one["n"] = ours["n"] + theirs["n"]
    a = a.copy()
    a[place[both]] = one
    new, at = b[~both], place[~both]
    out = np.empty(len(a) + len(new), ENTRY)
    out[np.arange(len(a)) + np.searchsorted(at, np.arange(len(a)), "right")] = a
    out[at + np.arange(len(new))] = new
    return out


def leaf(rows: pa.Table) -> pa.Table:
    """An owner's first run in a segment."""
    run = np.zeros(len(rows), ENTRY)
    run["digest"] = rows["digest"].to_numpy(zero_copy_only=False)
    run["none"] = rows["keep_id"].is_null().to_numpy()
    run["id"] = rows["keep_id"].fill_null(0).to_numpy()
    for name in ("row", "n", "n_bytes", "check"):
        run[name] = rows[name].to_numpy()
    return one_run(rows, run[np.argsort(run["digest"], kind="stable")])


def merge(runs: pa.Table, keep: str) -> pa.Table:
    """The run of up to FAN runs."""
    some = [np.frombuffer(x.as_buffer(), ENTRY) for x in runs["run"]]
    while len(some) > 1:
        some = [merged(*some[k : k + 2], keep) if k + 1 < len(some) else some[k] for k in range(0, len(some), 2)]
    return one_run(runs, some[0])


def one_run(given: pa.Table, run: np.ndarray) -> pa.Table:
    return pa.table({"segment": given["segment"][:1], "owner": given["owner"][:1], "run": pa.array([run.tobytes()], pa.binary())})


def entries(batches):
    for batch in batches:
        for x in batch.column("run"):
            run = np.frombuffer(x.as_buffer(), ENTRY)
            raw = np.ascontiguousarray(run["digest"]).view(np.uint8)
            digest = pa.Array.from_buffers(pa.binary(32), len(run), [None, pa.py_buffer(raw)]).cast(pa.binary())
            ids = pa.array(run["id"], mask=run["none"].astype(bool))
            yield pa.RecordBatch.from_arrays([digest, ids, pa.array(run["row"]), pa.array(run["n"])], ["digest", "keep_id", "keep_row", "n"])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. Of equal texts the row with the smallest identifier stays
    (keep="largest": the largest); null identifiers stay only if there is no other. Of rows that repeat an identifier
    and a text, one stays. An empty table gives an empty result. Other columns of docs are not read.
    """
    common.ship(docs.sparkSession)
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = common.stored(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.monotonically_increasing_id().alias("row"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
            F.octet_length(text).cast("long").alias("n_bytes"),
            F.xxhash64(text).alias("check"),
        ),
        "digests",
    )
    count = rows.count()
    segments = max(common.partitions(spark), math.ceil(count / SEGMENT_ROWS))
    best = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "row")
    if keep == "largest":
        retained = F.max(F.struct(F.col("doc_id").alias("id"), "row"))
    else:
        retained = F.min(best)
    agreed = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.raise_error(F.lit("two different texts have one SHA-256 digest"))).alias(c)
    runs = (
        rows.groupBy(F.pmod("check", F.lit(segments)).cast("int").alias("segment"), F.pmod(F.xxhash64("row"), F.lit(FAN**ROUNDS)).cast("int").alias("owner"), "digest")
        .agg(retained.alias("best"), F.count(F.lit(1)).alias("n"), agreed("n_bytes"), agreed("check"))
        .select("segment", "owner", "digest", F.col("best.id").alias("keep_id"), F.col("best.row").alias("row"), "n", "n_bytes", "check")
    )
    runs = runs.groupBy("segment", "owner").applyInArrow(leaf, RUN)
    for _ in range(ROUNDS):
        runs = runs.withColumn("owner", F.shiftright("owner", int(math.log2(FAN)))).groupBy("segment", "owner").applyInArrow(lambda t: merge(t, keep), RUN)
    runs = common.stored(runs.mapInArrow(entries, "digest binary, keep_id long, keep_row long, n long"), "runs")
    return common.join_counted(rows, runs, "digest", "n", count).select(
        "doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def without_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """docs with one row of each group of equal texts; other columns are unchanged, whatever their names.

    Null counts as empty; a null identifier stays only if its group has no other; of rows that repeat the retained
    identifier and text, one stays; an empty table gives an empty result.
    """
    found = exact_duplicates(docs, id_col, text_col, keep)
    group = found.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("doc_id", F.conv(F.substring("text_sha256", 1, 15), 16, 10).cast("long").alias("same"))
    return common.chosen(docs, common.stored(group.agg(F.count(F.lit(1)).alias("n")), "stay"), id_col, text_col, F.conv(F.substring(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256), 1, 15), 16, 10).cast("long"))
