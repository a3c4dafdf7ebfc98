"""The queries of this subpackage over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import bytebpe, chat, exactdedup, fingerprints, htmltext, langid, mixing, sharding, simhash, tokencount
from strandloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query(
    "op10_exact_dedup",
    """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
              doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
       FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
)
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


@query("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op6_mixing")
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op8_sharding")
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


@query("op3_byte_bpe")
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.encode(table(spark, sf_dir, "documents")).drop("same")


@query("op9_fingerprints")
def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = langid.trained(docs.filter(~langid.held_out()))
    found = langid.identify(docs, network)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@query("op4_html_text")
def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"), keep=["url"])


@query(
    "op5_chat_format",
    """WITH RECURSIVE
            said AS (SELECT *, length(coalesce(text, '')) AS n FROM conversations),
            calls AS (SELECT DISTINCT conv_id, turn, n % 7 <> 0 AND n % 5 <> 0 AS fits FROM said WHERE role IS DISTINCT FROM 'assistant'),
            results AS (SELECT DISTINCT conv_id, turn - 1 AS turn FROM said WHERE role = 'assistant' AND n % 9 <> 0),
            depths AS (
              SELECT conv_id, turn, 0 AS d FROM calls c
              WHERE NOT (turn % 8 >= 2 AND EXISTS (SELECT 1 FROM calls b WHERE b.conv_id = c.conv_id AND b.turn = c.turn - 2))
              UNION ALL
              SELECT c.conv_id, c.turn, d.d + 1 FROM depths d JOIN calls c ON c.conv_id = d.conv_id AND c.turn = d.turn + 2 AND c.turn % 8 >= 2),
            known AS (SELECT c.*, d.d FROM calls c JOIN depths d USING (conv_id, turn))
       SELECT s.conv_id, s.turn, CASE WHEN s.role = 'assistant' THEN 'tool' ELSE s.role END AS role,
              CASE WHEN s.role = 'assistant' THEN CASE WHEN s.n % 9 = 0 THEN 'lost:' ELSE '' END || s.conv_id || ':' || (s.turn - 1) ELSE s.conv_id || ':' || s.turn END AS call_id,
              CASE WHEN s.role = 'assistant' THEN coalesce(2 * k.d + 1, 0) ELSE 2 * o.d END AS depth,
              coalesce(k.turn, s.turn) AS follows,
              CASE WHEN s.role = 'assistant' THEN k.turn IS NOT NULL ELSE r.turn IS NOT NULL END AS linked,
              CASE WHEN s.role = 'assistant' THEN k.fits ELSE o.fits END AS valid,
              '{"content":' || coalesce(to_json(s.text)::VARCHAR, 'null') || CASE WHEN s.role = 'assistant'
                THEN ',"role":"tool","tool_call_id":"' || CASE WHEN s.n % 9 = 0 THEN 'lost:' ELSE '' END || s.conv_id || ':' || (s.turn - 1) || '"}'
                ELSE ',"role":' || coalesce(to_json(s.role)::VARCHAR, 'null') || ',"tool_calls":[{' || CASE WHEN s.turn % 8 >= 2 THEN '"after":["' || s.conv_id || ':' || (s.turn - 2) || '"],' ELSE '' END
                     || '"arguments":' || CASE WHEN s.n % 7 = 0 THEN '"turn=' || s.turn || '"' WHEN s.n % 5 = 0 THEN '{"n_chars":' || s.n || ',"turn":"' || s.turn || '"}' ELSE '{"n_chars":' || s.n || ',"turn":' || s.turn || '}' END
                     || ',"id":"' || s.conv_id || ':' || s.turn || '","name":"reply"}]}' END AS line
       FROM said s
       LEFT JOIN known k ON s.role = 'assistant' AND s.n % 9 <> 0 AND k.conv_id = s.conv_id AND k.turn = s.turn - 1
       LEFT JOIN known o ON s.role IS DISTINCT FROM 'assistant' AND o.conv_id = s.conv_id AND o.turn = s.turn
       LEFT JOIN results r ON s.role IS DISTINCT FROM 'assistant' AND r.conv_id = s.conv_id AND r.turn = s.turn""",
)
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.format_chats(chat.as_calls(table(spark, sf_dir, "conversations")), chat.SCHEMAS)
    return found.withColumn("call_id", F.element_at("call_ids", 1)).drop("call_ids")
