"""From raw documents to token ids: quality, near duplicates, contamination, mixture, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``. ``run`` writes the result of each stage to the shared folder and reads
it again for the next one, so a lost executor costs at most the stage at work.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioseek.llm import decontaminate, jaccard, mixing, quality, tokens
from folioseek.llm.native_queries import weights, with_domain
from folioseek.llm.queries import END_ID, TOKENIZER
from folioseek.llm.registry import read
from folioseek.plans.sizing import materialize, work_path

#: Documents below this probability of good quality go.
LEAST_QUALITY = 0.5
#: Shingles of five words, similarity 0.8.
WIDTH, SIMILAR, OF = 5, 80, 100
#: The mixture has this share of the tokens that come in, and no document more often than this.
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.8, 2, 29


def _packed(docs: DataFrame, *beside: str) -> DataFrame:
    """Whole rows in one column and what a stage looks at beside it, so no names can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole"), *beside)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of one fold, does not reject."""
    labels = read(spark, sf_dir, "labels", "doc_id", "quality")
    model = quality.train(docs, labels.where(quality.fold("doc_id", 3) != 1))
    scored = quality.score(_packed(docs, "text"), model, name="_score")
    return scored.where(F.col("_score") >= LEAST_QUALITY).select("_whole.*")


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the least id."""
    return jaccard.one_of_each(docs, WIDTH, SIMILAR, OF)


def no_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text."""
    items = read(spark, sf_dir, "benchmark", "item_id", "text")
    judged = decontaminate.contaminated(_packed(docs, "doc_id", "text"), items)
    return judged.where(~F.col("contaminated")).select("_whole.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mixture, once per epoch; the one in which a budget ends comes whole."""
    placed = with_domain(_packed(docs, "doc_id", "text", "lang", "source"))
    budget = F.floor(F.sum("tokens") * MIX_SHARE)
    return mixing.mix(placed, weights(spark), budget, max_epochs=MIX_EPOCHS, seed=MIX_SEED).select("_whole.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written to binary segments; one row per document read back from them."""
    path = work_path(spark, "tokens")
    tokens.write(docs.select("doc_id", "text"), path, public_tokenizers.path(TOKENIZER), END_ID)
    return tokens.read(spark, path).drop("segment")


STAGES = [
    ("quality_classifier", good_quality),
    ("jaccard_join", no_near_duplicates),
    ("decontamination", no_benchmark_text),
    ("source_mixing", mixture),
    ("token_ids", token_ids),
]

#: The classifier and the tokenizer are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
