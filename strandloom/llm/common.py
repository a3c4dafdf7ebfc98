"""What several operators need: tables, written intermediate results, sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.plans import tables
from strandloom.plans.tables import forget, shared_dir  # noqa: F401
from strandloom.session import ship

#: The white space that ends a word, as characters.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str, compression: str = "none") -> DataFrame:
    """df as a table in the shared folder (see plans.tables).

    Without compression by default: most are narrow tables of hashes, often in many small files, and a codec's buffers for each of
    them stay outside the heap until the executor happens to collect its garbage.
    """
    return tables.stored(df, label, compression)


def swept(spark: SparkSession) -> None:
    """Let the executors collect their garbage, so that heap that nothing uses and buffers outside it go back to the system.

    Their heaps grow up to the limit with what earlier steps left, beside the Python workers, and shrink only in a full collection.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, with underscores before them until df has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_words(text) -> F.Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text; null counts as empty."""
    spaced = F.trim(F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS)))
    return F.when(spaced == "", F.lit(0)).otherwise(F.size(F.split(spaced, " +"))).cast("long")


def sliced(batches, size: int = 2_000_000):
    """Arrow batches in slices whose buffers hold about `size` bytes, so that a worker's memory follows neither the number of a batch's rows nor their length."""
    for batch in batches:
        step = max(1, int(len(batch) * min(1.0, size / max(batch.nbytes, 1))))
        for at in range(0, len(batch), step):
            yield batch.slice(at, step)


def join_counted(left: DataFrame, right: DataFrame, key: str, n: str, rows: int, parts: int = 10_000) -> DataFrame:
    """Inner join of left with right, which has one row per key and in column n the number of left's rows with that key.

    A key with more than rows / parts of left's rows is hot: at most `parts` keys can be, so that side is broadcast
    with a proven bound and the hot rows stay where they are. All others are joined by a shuffle of the key.
    Both inputs are read twice, so they should be stored tables. Null keys join nothing.
    """
    limit = max(1000, rows // parts)
    hot = F.broadcast(right.filter(F.col(n) > limit))
    return left.join(hot, key).unionByName(left.join(hot.select(key), key, "left_anti").join(right.filter(F.col(n) <= limit), key))


def chosen(docs: DataFrame, stay: DataFrame, id_col: str, text_col: str, same: F.Column | None = None) -> DataFrame:
    """The rows of docs whose identifier and text hash are in stay (doc_id, same, n: rows of docs with both); of rows that repeat both, one.

    Null identifiers match null identifiers; a null text has the hash of an empty one. Columns of docs keep names and values:
    helper columns get names that docs does not have. An empty table on either side gives an empty result.
    """
    same = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) if same is None else same
    hash_, id_, same_ = fresh(docs, "hash", "id", "same")
    several = not stay.filter("n > 1").isEmpty()
    stay = stay.select(F.col("doc_id").alias(id_), F.col("same").alias(same_))
    joined = docs.withColumn(hash_, same).join(stay, F.col(id_col).eqNullSafe(F.col(id_)) & (F.col(hash_) == F.col(same_)), "left_semi")
    if several:
        joined = joined.dropDuplicates([id_col, hash_])
    return joined.drop(hash_)
