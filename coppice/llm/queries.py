"""Registered queries of the operators, and their SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.llm.common import pick
from coppice.llm.decontaminate import contamination, matches
from coppice.llm.edits import with_next
from coppice.llm.jaccard import similar_groups
from coppice.llm.licenses import license_scan
from coppice.llm.lm import score_texts
from coppice.llm.mixing import mix
from coppice.llm.oracles import ORACLES
from coppice.llm.quality import score_quality
from coppice.llm.runs import periodic_runs, planted
from coppice.llm.substrings import repeats
from coppice.llm.tokens import load_pieces, token_counts
from coppice.llm.urls import Rule, judge_urls
from coppice.llm.warc import archived
from coppice.llm.whiten import whiten

# The rules of op8.
URL_RULES = [
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = load_pieces(str(public_tokenizers.path("piece_bpe_32k.model")))
    return token_counts(table(spark, sf_dir, "documents"), pieces)


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))


def mix_documents(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Mix by word counts; text whose words are of usual length counts as twice as good."""
    names = dict.fromkeys(["doc_id", "source", "text", *keep])
    sized = pick(docs, *names).withColumn("n", word_count())
    per_word = F.try_divide(F.length("text"), F.col("n"))
    quality = F.when((F.col("n") > 0) & per_word.between(4, 11), 1.0).otherwise(0.5)
    return mix(sized, F.col("n"), quality, keep=keep)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "begin", "end", "kept_doc_id", "kept_word")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), planted).drop("n_words", "n_kept")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archived(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_mix": op2_mix,
    "op3_fingerprints": op3_fingerprints,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_license_scan": op5_license_scan,
    "op6_decontaminate": op6_decontaminate,
    "op7_lm_score": op7_lm_score,
    "op8_url_filter": op8_url_filter,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_quality": op10_quality,
    "op11_whiten": op11_whiten,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_warc": op13_warc,
}

__all__ = ["ORACLES", "QUERIES"]
