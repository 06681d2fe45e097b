"""The registered queries of the text operators: each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.llm import (
    decontaminate,
    licenses,
    mixing,
    ngrams,
    pages,
    periodicity,
    quality,
    resampling,
    sharding,
    simhash,
    substrings,
    toxicity,
    weights,
    wordpieces,
)
from stopwise.llm.common import let, table, words


# The vocabulary that the token counts use; any file of its form will do.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return wordpieces.count_tokens(docs, VOCABULARY)


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", "n_chars", "n_deleted")


def repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = substrings.repeated_substrings(docs, length=400)
    n_spans = F.size("spans").cast("long").alias("n_spans")
    return found.select("doc_id", "n_bytes", "n_removed", n_spans, "kept_sha256", (F.col("n_removed") > 0).alias("repeated"))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return quality.judge(docs).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "removed_words",
    )


def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs, shingle=3, max_bits=3)
    return found.select("doc_id", "fingerprint", "component_id")


def histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(docs, shards=16).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngrams.score_texts(docs, parts=7, held_out=2)


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    weight = weights.fit_weight(docs, table(spark, sf_dir, "labels"))
    mixed = mixing.mix(docs, total_share=1.5, most=2.0, weights=(5, 2, 1), weight=weight)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), window=13)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """Every tenth text, by a hash of its id, repeats a part of itself from some word on, as the query's contract says.

    With h the CRC-32 of the decimal id, g its tenth part, and n words, each word i >= a becomes word
    a + (i - a) mod p, where a = g mod n and p = 1 + floor((n - a) / (3 + g mod 8)). A null id repeats nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("bigint")

    def repeated(found):
        n = F.size(found).cast("bigint")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("bigint")
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        moved = F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get(found, place(i).cast("int")))
        return F.when(n > 0, F.array_join(moved, " ")).otherwise(F.lit(""))

    text = F.when(h % 10 == 0, let(words(F.col("text")), repeated)).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodicity.find_runs(with_planted_periods(docs), least=24, exponent=3)
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    top = F.col("strongest")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        top["start"].alias("start"),
        top["length"].alias("length"),
        top["period"].alias("period"),
        F.floor(1000 * top["length"] / top["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = resampling.resample(docs, table(spark, sf_dir, "benchmark"), seed=7, percent=25, least_words=20)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    remainder = lambda key: F.crc32(key.cast("string").cast("binary")) % 3
    labels = table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels, learn_from=remainder(F.col("_key")) != 1)
    held_out = F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out")
    return toxicity.score_texts(docs, model, threshold=0.7).select("doc_id", held_out, "score", "predicted")


QUERIES = {
    "op1_token_counts": token_counts,
    "op2_page_text": page_text,
    "op3_repeated_strings": repeated_strings,
    "op4_quality_rules": quality_rules,
    "op5_simhash_groups": simhash_groups,
    "op6_histogram_shards": histogram_shards,
    "op7_language_scores": language_scores,
    "op8_source_mix": source_mix,
    "op9_benchmark_hits": benchmark_hits,
    "op10_license_scan": license_scan,
    "op11_periodic_runs": periodic_runs,
    "op12_target_resampling": target_resampling,
    "op13_toxicity_scores": toxicity_scores,
}
