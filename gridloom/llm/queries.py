"""The opN_ queries: each operator over its whole table, reduced to digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import bpe_tree, chat_format, decontaminate, line_dedup, near_dedup, pii, repeat_removal, token_files, topk_search, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(f"SELECT -7L AS conv_id, cast(t as bigint) AS turn, r AS role, '{said}' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS v(t, r)")
    return chat_format.conversation_digests(chat_format.format_blocks(turns.unionByName(extra)))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(_read(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", 5)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"), words=2, share=80)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan_documents(_read(spark, sf_dir, "documents"))


def op6_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.encode_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op7_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_removal.remove_repeats(_read(spark, sf_dir, "documents"), with_kept=False)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).selectExpr("doc_id", "n_lines", "n_dropped", "sha2(kept_text, 256) AS kept_sha256")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    lexicon = toxicity.fit(docs, _read(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", "text").withColumn("held_out", toxicity.held_out())
    return toxicity.score_documents(rows, lexicon, ["doc_id", "held_out"])


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_table(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_chat_format, op2_topk_search, op3_decontaminate, op4_near_dedup, op5_pii, op6_bpe_tree, op7_repeat_removal, op8_line_dedup, op9_toxicity, op10_token_files)}


_ESC = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')"


def oracle_sql() -> dict[str, str]:
    head = len(chat_format.ChatTemplate.turn_open) + 1 + len(chat_format.ChatTemplate.turn_close)
    return {
        "op1_chat_format": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, v.t, v.r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
f AS (SELECT *, {head} + length({_ESC.format("role")}) + length({_ESC.format("text")}) AS chars FROM t),
c AS (SELECT *, coalesce(sum(chars) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  count(*) FILTER (WHERE role = 'assistant') AS n_examples,
  CAST(coalesce(sum(before) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS context_chars
FROM c GROUP BY conv_id""",
        "op2_topk_search": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5""",
        "op8_line_dedup": """
WITH l AS (
  SELECT doc_id, u.line, u.pos, translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents) u),
m AS (SELECT *, length(k) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY k) AS gone FROM l)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    }
