"""From raw documents to packed training sequences: five stages, each written as Parquet and read again as the next one's input.

1. ``toxicity``: documents that the factorization machine scores 0.5 or more go.
2. ``near_dup``: of documents linked by 5-word shingles at a similarity of 0.8 or more, the one of smallest doc_id stays.
3. ``substring_dedup``: repeated passages are cut from all but the earliest document that holds them; a document that is left
   without text goes.
4. ``decontaminate``: documents that hold a benchmark item go.
5. ``pack``: what is left is packed into sequences of 2048 tokens; this stage's rows are pieces, not documents.

No SQL can express the machine, the signatures or the packing, so there is none; the tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import decontaminate, near_dup, packing, substring_dedup, toxicity
from gristmill.llm._shared import fold, table, write_table
from gristmill.llm.queries import tokenizer_path

ORACLE_SQL = None


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the machine scores under 0.5, as they are. Null and empty texts score what no term says and stay where clean
    texts are the rule; rows without doc_id are scored like any; repeated rows score alike; an empty table gives none."""
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0).select("doc_id", F.col("toxic").alias("label"))
    scored = toxicity.score_rows(docs, toxicity.fit(docs, labels))
    return scored.where("score < 0.5").select("carried.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id. Rows that share a doc_id are one document, of
    which the row stays whose text sorts first (null before all; of equal texts, whose other columns sort first as JSON). Texts
    without words are in no group. Rows without doc_id all stay. An empty table gives none."""
    groups = near_dup.near_duplicates(docs, near_dup.Plan(shingle=5, percent=80))
    firsts = groups.where("doc_id = component_id").select("doc_id").distinct()
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    order = F.struct(docs["text"], F.to_json(F.struct(F.lit(0).alias("_"), *[docs[c] for c in others])).alias("others"))
    known = docs.where("doc_id is not null").join(firsts.hint("merge"), "doc_id", "left_semi")
    one = known.groupBy("doc_id").agg(F.min_by(F.struct(*[docs[c] for c in docs.columns]), order).alias("row")).select("row.*")
    return one.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row with the repeated lines and runs cut from its text, and n_chars (if there is one) of what is left; a row that is left
    without a word goes. Null and empty texts stay as they are; so do rows without doc_id, which neither own nor lose anything;
    repeated rows are cut alike. An empty table gives none."""
    cleaned = substring_dedup.clean_rows(docs).where((F.col("removed_words") == 0) | F.col("clean").rlike(r"[^\x20\x09-\x0D]"))
    text = {"text": F.col("clean"), "n_chars": F.when(F.col("removed_words") == 0, F.col("carried")["n_chars"]).otherwise(F.length("clean")).cast("long")} if "n_chars" in docs.columns else {"text": F.col("clean")}
    return cleaned.select(*[text[c].alias(c) if c in text else F.col("carried")[c].alias(c) for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of documents that hold no benchmark item. Null and empty texts hold none; rows without doc_id stay; rows that share a
    doc_id go together. An empty table, or an empty benchmark, drops nothing."""
    leaks = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places; null and empty texts are a piece of the end id, repeated rows pieces of their
    own, an empty table gives none."""
    return packing.pack(docs, packing.Packing(tokenizer_path("word_bpe_49k.json")))


STAGES = [("toxicity", keep_clean), ("near_dup", keep_one_of_each), ("substring_dedup", cut_repeats), ("decontaminate", drop_leaks), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out = write_table(stage(spark, out, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, out, sf_dir)
