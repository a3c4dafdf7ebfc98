"""The corpus pipeline: language identification, exact and near duplicates, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and works on all rows and whole texts that the stage before kept. Null texts count
as empty, null identifiers and repeated rows are rows like any other, columns beside those of documents pass through
whatever their names (but for the last stage, which has its own), and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import bytebpe, common, exactdedup, langid, mixing, simhash

#: A document stays if its language is more probable than chance by this much: short and mixed texts are no reason to go.
OVER_CHANCE = 0.05


def least_score(network: langid.Network | None) -> float:
    """The least mean probability with which a document stays; with one language all with a letter do."""
    n = len(network.languages) if network else 1
    return 1 / n + OVER_CHANCE if n > 1 else 0.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the labelled ones have; null and empty texts, texts without a letter and texts that no language fits go. Repeated rows stay repeated. Without labelled documents nothing stays."""
    common.swept(spark)
    network = langid.trained(docs.filter(~langid.held_out()))
    return langid.identify(docs, network, keep=docs.columns, least=least_score(network)).select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, null being empty, the row of the largest identifier; a null identifier only without another, one of repeated rows."""
    common.swept(spark)
    return exactdedup.without_exact_duplicates(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more of their sets of five-word shingles, the row of the smallest identifier; texts without words are alike, a null identifier stays only without another."""
    common.swept(spark)
    return simhash.without_near_duplicates(docs, sets=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; texts without words have no size and come as often as their source's are taken whole. A null source is one of its own; rows of one identifier are taken alike."""
    common.swept(spark)
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, a row for each row; a null text has no tokens."""
    common.swept(spark)
    return bytebpe.encode(docs).drop("same")


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("encode", encode)]

#: The network has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents. Each stage's result is written as Parquet and read again; the one before is deleted then."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, common.stored(stage(spark, docs, sf_dir), name, "snappy")
        if name != STAGES[0][0]:
            common.forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
