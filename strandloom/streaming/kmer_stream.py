"""Running k-mer counts over a folder of read files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandloom.operators.kmers import canonical_counts


def read_stream(spark: SparkSession, path: str, schema: str = "read_id long, seq string", max_files: int = 100) -> DataFrame:
    """Reads from Parquet files as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def counts_by_batch(reads: DataFrame, k: int, out: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's canonical counts under out/batch=<n>. The state is the folder, not memory: k-mers never expire, so a streaming aggregation would hold all of them. A batch that is run again overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        canonical_counts(batch, k).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return reads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """(kmer, n) over all batches so far."""
    return spark.read.parquet(out).groupBy("kmer").agg(F.sum("n").alias("n"))
