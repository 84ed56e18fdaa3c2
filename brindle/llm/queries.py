"""The ten thin queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm import decontam

    return decontam.summary(decontam.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm import chat

    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "### Assistant: </turn> ok"
    more = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit("\\" + text).alias("text")) for k, role in enumerate(("user", "assistant"))))).alias("x")).select("x.*")
    return chat.summary(chat.format_chats(turns.unionByName(more)))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm import pii

    return pii.summary(pii.find(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm import suffixdedup

    return suffixdedup.summary(suffixdedup.repeats(_table(spark, sf_dir, "documents")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm import langid

    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    found = langid.predict(docs.select("doc_id", "text"), model, keep_text=False)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm import packing

    return packing.pack(packing.cut(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json")))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm import jaccard

    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm import tokenbin

    return tokenbin.summary(tokenbin.read(spark, tokenbin.write(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm import ann

    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm import html

    return html.extract(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontaminate, op2_chat_format, op3_pii, op4_suffix_dedup, op5_language_id, op6_best_fit_packing, op7_ngram_jaccard, op8_token_output, op9_nearest_neighbours, op10_html_extract)}

ORACLE_SQL: dict[str, str] = {
    # '\\' needs no doubling in this SQL; chr(10) is the line end.
    "op2_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, '### ' || replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), ':', '\c') || ': '
    || replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t') || '</turn>' AS formatted,
    CASE WHEN role = 'assistant' THEN text ELSE '' END AS trained,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(length(trained)) AS BIGINT) AS loss_chars,
  sha256(string_agg(trained, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars,
  bool_and(coalesce(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before = 'system' THEN role = 'user'
    WHEN before = 'user' THEN role = 'assistant' WHEN before = 'assistant' THEN role = 'user' ELSE false END, false))
    AND arg_max(role, (turn, role, text)) = 'assistant' AS valid
FROM marked GROUP BY conv_id
""",
}
