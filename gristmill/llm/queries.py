"""One query per training-data operator, with production parameters, over whole tables; and SQL where it can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import decontaminate, language_id, near_dup, packing, quality_classifier, quality_rules, quotation, substring_dedup, toxicity, warc
from gristmill.llm._shared import fold, table


def tokenizer_path(name: str) -> str:
    """The folder of public tokenizer files: ``GRISTMILL_TOKENIZERS``, or the installed package."""
    if folder := os.environ.get("GRISTMILL_TOKENIZERS"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 4) == 2
    model = language_id.fit(docs.where(~held))
    return language_id.predict(docs, model).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    seen = labels.where(fold(F.col("doc_id"), 4) != 2).select("doc_id", F.col("quality").alias("label"))
    scored = quality_classifier.score(docs, quality_classifier.fit(docs, seen))
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    seen = labels.where(fold(F.col("doc_id"), 4) != 2).select("doc_id", F.col("quality").alias("label"))
    return quality_rules.judge(docs, quality_rules.fit(docs, seen))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.Packing(tokenizer_path("word_bpe_49k.json")))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(table(spark, sf_dir, "documents"), near_dup.Plan(shingle=3, percent=85))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    seen = labels.where(fold(F.col("doc_id"), 5) != 0).select("doc_id", F.col("toxic").alias("label"))
    scored = toxicity.score(docs, toxicity.fit(docs, seen))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotation.link_quotations(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_language_id": op3_language_id,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_quality_rules": op5_quality_rules,
    "op6_pack": op6_pack,
    "op7_warc": op7_warc,
    "op8_minhash_near_dup": op8_minhash_near_dup,
    "op9_toxicity": op9_toxicity,
    "op10_quotation_linking": op10_quotation_linking,
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BITS = "CAST('0x' || substr(sha1(coalesce(html, '')), g * 5 + 1, 5) AS BIGINT)"
_LETTERS = " || ".join(f"substr('{warc.BASE32}', (({_BITS} >> {s}) & 31)::BIGINT + 1, 1)" for s in (15, 10, 5, 0))

ORACLES: dict[str, str] = {
    "op7_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS payload_bytes,
                          array_to_string(list_transform(range(8), lambda g: {_LETTERS}), '') AS payload_digest FROM pages),
             m AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS last FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id < last THEN last END AS refers_to FROM m""",
    "op8_minhash_near_dup": f"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
             s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
                                                     WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
             n AS (SELECT doc_id, len(sh) AS n FROM s), x AS (SELECT doc_id, unnest(sh) AS g FROM s),
             p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
             l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
             e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
             r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
             m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
        SELECT doc_id, n::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN m USING (doc_id)""",
}
