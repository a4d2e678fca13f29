"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are runs of 1 to 3 code points of the lower-cased text, in which everything but
letters is a blank and runs of blanks are one. A value is count times inverse document
frequency, the vector of a text has length 1. Document frequencies are counted over all
learning texts by Spark. Weights are fitted by follow-the-regularised-leader with L1 and L2
penalties on a bounded sample of each language; a temperature fitted on a part of that
sample kept aside then calibrates the softmax.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioseek.llm import batches
from folioseek.llm.joins import lookup
from folioseek.llm.samples import one_text_each
from folioseek.plans.shipping import ship_package
from folioseek.plans.sizing import materialize

BITS = 15
WIDTHS = (1, 2, 3)
UNKNOWN = "und"
#: Bounds of the learning texts read per language, and in all; many languages share the latter evenly.
ROWS_PER_LANGUAGE, ROWS = 300, 24_000
EPOCHS = 3
CHUNK_BYTES = 1 << 18
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.05

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float


def _vectors(texts: pa.Array):
    """For each text its distinct buckets and their counts, and whether it has a letter."""
    letters = _is_letter()
    for _, _, data, offsets in batches.chunks(texts, CHUNK_BYTES):
        points, at = batches.code_points(data, offsets)
        kept = letters[points]
        letter_count = np.concatenate([[0], np.cumsum(kept)])
        spaced = np.where(kept, points, np.uint32(32))
        first = np.zeros(len(points), bool)
        first[at[:-1][at[:-1] < at[1:]]] = True
        use = kept.copy()
        use[1:] |= kept[:-1]
        use |= first
        before = np.concatenate([[0], np.cumsum(use)])
        at2 = before[at]
        parts = [batches.gram_buckets(spaced[use], at2, w, BITS) for w in WIDTHS]
        for i in range(len(offsets) - 1):
            own = np.concatenate([b[f[i] : f[i + 1]] for b, f in parts])
            if len(own) > 1 << BITS:
                count = np.bincount(own, minlength=1 << BITS)
                bucket = np.flatnonzero(count)
                count = count[bucket]
            else:
                bucket, count = np.unique(own, return_counts=True)
            yield bucket, count, letter_count[at[i + 1]] > letter_count[at[i]]


def _weighted(bucket: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    value = count * idf[bucket]
    return value / max(np.sqrt(value @ value), 1e-12)


def _softmax(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], truth: np.ndarray, classes: int, seed: int = 11):
    """Follow-the-regularised-leader with per-weight rates; returns weights and biases."""
    size = (1 << BITS) + 1
    z, n = np.zeros((size, classes)), np.zeros((size, classes))

    def weights(at):
        zs = z[at]
        shrunk = np.sign(zs) * np.maximum(np.abs(zs) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            bucket, value = rows[i]
            at, x = np.append(bucket, size - 1), np.append(value, 1.0)
            w = weights(at)
            p = _softmax(x @ w)
            p[truth[i]] -= 1
            g = np.outer(x, p)
            old = n[at]
            z[at] += g - (np.sqrt(old + g * g) - np.sqrt(old)) / ALPHA * w
            n[at] = old + g * g
    w = weights(np.arange(size))
    return w[:-1], w[-1]


def calibrate(logits: np.ndarray, truth: np.ndarray) -> float:
    """Temperature with the least log loss on rows not fitted, by golden section over its logarithm."""
    if not len(truth):
        return 1.0

    def loss(log_t: float) -> float:
        p = _softmax(logits / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(truth)), truth], 1e-12)).mean()

    low, high, golden = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(docs: DataFrame, per_language: int = ROWS_PER_LANGUAGE, rows: int = ROWS) -> LanguageModel:
    """Learn from ``text`` and non-null ``lang`` of ``docs``; ``doc_id`` only orders the sample.

    Every value of ``lang`` is learned, from at most ``per_language`` documents each and about ``rows`` in all,
    but always from some. Fitting takes half a megabyte a language on the driver, the model an eighth. Of
    repeated ids of a language the least text is read. Texts without a letter teach nothing; with no
    language, every text is later called ``und``.
    """
    ship_package(docs.sparkSession)
    docs = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())

    def frequencies(parts):
        seen = np.zeros(1 << BITS, np.int64)
        texts = 0
        for part in parts:
            for bucket, _, has_letter in _vectors(part.column(0)):
                if has_letter:
                    seen[bucket] += 1
                    texts += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(seen[at], texts), pa.int64())],
            ["bucket", "n"],
        )

    counted = (
        docs.select("text")
        .mapInArrow(frequencies, "bucket int, n bigint")
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    df = np.zeros((1 << BITS) + 1)
    df[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    total = df[-1]
    idf = np.log((1 + total) / (1 + df[:-1])) + 1

    sizes = materialize(docs.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")), "languages")
    per_language = min(per_language, max(5, rows // max(1, sizes.count())))
    # a hash threshold leaves about four times the rows wanted of each language, whatever its size; of those the first count
    draw = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 30)).cast("double")
    drawn = docs.select("doc_id", "lang").where("doc_id is not null").transform(lambda d: lookup(d, sizes, "lang"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "lang"), "doc_id")
    chosen = (
        drawn.where(draw < F.lit(4.0 * per_language * (1 << 30)) / F.col("_n"))
        .select("doc_id", "lang").distinct()
        .withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= per_language)
    )

    @F.arrow_udf("binary")
    def counts(texts: pa.Array) -> pa.Array:
        return pa.array(
            [
                b.astype(np.int32).tobytes() + c.astype(np.int32).tobytes() if letter else None
                for b, c, letter in _vectors(texts)
            ],
            pa.binary(),
        )

    sample = (
        one_text_each(docs, chosen.drop("_at"), "lang", "doc_id")
        .select("doc_id", "lang", counts("text").alias("c"))
        .where("c is not null")
        .toArrow()
    )
    rows = sorted(zip(*(sample.column(i).to_pylist() for i in range(3)), strict=True))
    languages = tuple(sorted({r[1] for r in rows}))
    if not languages:
        return LanguageModel((), idf, np.zeros((1 << BITS, 0)), np.zeros(0), 1.0)
    at = {name: i for i, name in enumerate(languages)}
    vectors, truth = [], []
    for _, name, raw in rows:
        bucket, count = np.frombuffer(raw, np.int32).reshape(2, -1)
        vectors.append((bucket, _weighted(bucket, count, idf)))
        truth.append(at[name])
    truth = np.array(truth)
    # every fifth of each language, so that all are fitted however the rows alternate
    order = np.argsort(truth, kind="stable")
    place = np.empty(len(truth), np.int64)
    place[order] = np.arange(len(truth)) - np.searchsorted(truth[order], truth[order])
    aside = place % 5 == 4
    fitted = [v for v, a in zip(vectors, aside, strict=True) if not a]
    weights, bias = fit(fitted, truth[~aside], len(languages))
    logits = np.array([x @ weights[b] + bias for (b, x), a in zip(vectors, aside, strict=True) if a])
    temperature = calibrate(logits.reshape(-1, len(languages)), truth[aside])
    return LanguageModel(languages, idf, weights.astype(np.float32), bias, temperature)


def predict(texts: pa.Array, model: LanguageModel) -> tuple[list[str], list[float]]:
    names, found = [], []
    for bucket, count, has_letter in _vectors(texts):
        if not has_letter or not model.languages:
            names.append(UNKNOWN)
            found.append(1.0 if not has_letter else 0.0)
            continue
        value = _weighted(bucket, count, model.idf).astype(np.float32)
        p = _softmax((value @ model.weights[bucket] + model.bias) / model.temperature)
        best = int(p.argmax())
        names.append(model.languages[best])
        found.append(float(p[best]))
    return names, found


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and its probability ``score``; columns of these names are replaced.

    Null texts and texts without a letter are ``und`` with score 1; without any learned
    language every text is ``und`` with score 0 unless it has no letter.
    """
    ship_package(docs.sparkSession)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def told(texts: pa.Array) -> pa.Array:
        names, found = predict(texts, model)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.float64())], ["lang_pred", "score"])

    marked = docs.withColumn("_told", told(text))
    return marked.withColumns({"lang_pred": F.col("_told.lang_pred"), "score": F.col("_told.score")}).drop("_told")
