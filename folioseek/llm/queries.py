"""The thin queries over the operators: whole tables in, the agreed columns out."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioseek.llm import fingerprint, importance, jaccard, langid, native_queries, periodic, pii, quality, sql, suffix_tree, tokens, vectors  # noqa: F401
from folioseek.llm.registry import QUERIES, SQL, query, read
from folioseek.plans.sizing import work_path

__all__ = ["QUERIES", "SQL"]

TOKENIZER, END_ID = "byte_bpe_50k.json", 2


@query("op1_quality_classifier")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored; labels of the fold that is held out are not read."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    labels = read(spark, sf_dir, "labels", "doc_id", "quality")
    model = quality.train(docs, labels.where(quality.fold("doc_id", 3) != 1))
    return quality.score(docs, model).select(
        "doc_id",
        F.coalesce(quality.fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; a fifth of the documents teaches nothing."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = langid.train(docs.where(quality.fold("doc_id", 5) != 0))
    return langid.identify(docs.drop("lang"), model).select(
        "doc_id",
        F.coalesce(quality.fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
    )


@query("op4_document_fingerprints")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's digest, its edited text's, and the next document's."""
    return fingerprint.compare_with_next(read(spark, sf_dir, "documents", "doc_id", "text"))


@query("op5_token_ids")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens written and read back."""
    path = work_path(spark, "tokens")
    tokens.write(read(spark, sf_dir, "documents", "doc_id", "text"), path, public_tokenizers.path(TOKENIZER), END_ID)
    return tokens.read(spark, path).drop("segment")


@query("op2_pii")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base spans, and those that the random field adds."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return pii.annotate(docs, pii.train(docs)).drop("text")


@query("op10_lm_scores")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability; a seventh of the documents teaches nothing."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    tree, vocabulary = suffix_tree.train(docs.where(quality.fold("doc_id", 7) != 2))
    return suffix_tree.score(docs, tree, vocabulary, "doc_id").select(
        "doc_id",
        F.coalesce(quality.fold("doc_id", 7) == 2, F.lit(False)).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(tree.total).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


@query("op6_jaccard_join")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component under links of 85 % of 4-word shingles."""
    return jaccard.group(read(spark, sf_dir, "documents", "doc_id", "text"), width=4, num=85, den=100).drop("text_hash")


@query("op12_importance_resampling", sql.OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark's words, and the quarter that is drawn."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return importance.resample(docs, read(spark, sf_dir, "benchmark", "text"), seed=7, num=25, den=100)


@query("op13_embedding_near_dedup", sql.OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links of cosine 0.98 within its label, and its component."""
    return vectors.near_copies(read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), least=0.98)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Documents of which a tenth, by the hash of the id, repeat one stretch of their words to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    cut = docs.select("doc_id", "text", F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), 0).alias("w"), h.alias("h"))
    n, g = F.size("w"), F.floor(F.col("h") / 10)
    at = cut.withColumn("a", g % F.greatest(n, F.lit(1))).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    word = lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))
    planted = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), word), " ")
    return at.select("doc_id", F.when((F.col("h") % 10 == 0) & (n > 0), planted).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's runs of words, the longest of them, and its text without the repeats."""
    found = periodic.collapse(with_planted_runs(read(spark, sf_dir, "documents", "doc_id", "text")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("back"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    length = -F.col("best.back")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
