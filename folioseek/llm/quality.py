"""Quality classifier: averaged subword vectors and a softmax.

Every word and every run of 3 and 4 code points of a text falls by its hash into a bucket with
a learned vector, and so does, for every word, the mark whether it repeats the word before; a
document is the mean of its vectors, and a softmax over two classes reads it. Vectors and
softmax are trained together by stochastic gradient descent in numpy.

The score needs only the difference of the two logits, which is linear in the mean; so the
model sent to the tasks is one number per bucket and one bias.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioseek.llm import batches
from folioseek.llm.samples import collected, one_text_each
from folioseek.plans.shipping import ship_package

BITS = 18
WIDTHS = (3, 4)
DIM = 8
EPOCHS = 8
RATE = 0.5
#: Bounds of the labelled documents that training reads, and of their distinct features together (8 bytes each).
TRAIN_ROWS, TRAIN_FEATURES = 2000, 1 << 25
SEED = 7


@dataclass(frozen=True)
class QualityModel:
    """``margins[b]``: what one feature in bucket ``b`` adds to logit(1) - logit(0), before averaging."""

    margins: np.ndarray
    bias: float
    bits: int = BITS


def features(data: np.ndarray, offsets: np.ndarray, bits: int):
    """Buckets of words, repeat marks and code point runs, each with the number before every text."""
    words, first = batches.word_hashes(data, offsets, values=batches.EXACT)
    yield (words >> np.uint64(64 - bits)).astype(np.int32), first
    again = np.zeros(len(words), np.int32)
    again[1:] = words[1:] == words[:-1]
    again[first[:-1][first[:-1] < len(words)]] = 0
    yield again, first
    points, at = batches.code_points(data, offsets)
    for width in WIDTHS:
        yield batches.gram_buckets(points, at, width, bits)


def counts_of(texts: pa.Array, bits: int) -> pa.Array:
    """Distinct buckets and their counts, as bytes: int32 buckets, then int32 counts."""
    found = []
    for _, _, data, offsets in batches.chunks(texts):
        parts = list(features(data, offsets, bits))
        for i in range(len(offsets) - 1):
            own = np.concatenate([b[first[i] : first[i + 1]] for b, first in parts])
            bucket, count = np.unique(own, return_counts=True)
            found.append(bucket.astype(np.int32).tobytes() + count.astype(np.int32).tobytes())
    return pa.array(found, pa.binary())


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = BITS, seed: int = SEED) -> QualityModel:
    """Train on ``(buckets, counts)`` per document and labels 0 or 1.

    With no rows, or one class only, the model gives the same score to every text: the share
    of label 1, smoothed by one row of each class.
    """
    share = (labels.sum() + 1.0) / (len(labels) + 2.0)
    start = float(np.log(share / (1 - share)))
    if len(set(labels.tolist())) < 2:
        return QualityModel(np.zeros(1 << bits, np.float32), start, bits)
    rng = np.random.default_rng(seed)
    vectors = np.empty((1 << bits, DIM), np.float32)
    for some in np.array_split(vectors, 16):  # the same numbers as at once, without all of them in double precision
        some[:] = rng.uniform(-0.5, 0.5, some.shape).astype(np.float32) / DIM
    out = rng.normal(0, 1.0, (DIM, 2)).astype(np.float32)
    bias = np.array([0.0, start], np.float32)
    steps, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            bucket, count = rows[i]
            rate = RATE * (1 - done / steps)
            done += 1
            part = (count / max(1, count.sum())).astype(np.float32)
            hidden = part @ vectors[bucket]
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = out @ p
            out -= rate * np.outer(hidden, p)
            bias -= 0.1 * rate * p
            # a mean moves little when thousands of vectors share the step: scale it by the largest share
            vectors[bucket] -= (rate / max(part.max(initial=0.0), 1e-6)) * np.outer(part, back)
    return QualityModel(vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]), bits)


def scores(texts: pa.Array, model: QualityModel) -> np.ndarray:
    """Probability of label 1 for every text; an empty or null text has the bias alone."""
    found = np.empty(len(texts))
    for low, high, data, offsets in batches.chunks(texts):
        total, n = np.zeros(high - low), np.zeros(high - low)
        for bucket, first in features(data, offsets, model.bits):
            total += batches.by_offsets(model.margins[bucket], first)
            n += np.diff(first)
        found[low:high] = total / np.maximum(n, 1) + model.bias
    return 1 / (1 + np.exp(-np.clip(found, -500, 500)))


def train(
    docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, bits: int = BITS, features: int = TRAIN_FEATURES
) -> QualityModel:
    """Fit on at most ``rows`` labelled documents, chosen by a hash of their id.

    ``docs``: doc_id, text; ``labels``: doc_id, quality. Rows with a null id or label do not
    count, nor do documents with two different labels or without a text; of repeated documents the one with the
    least text is read. In the order of the hash, documents are read as far as they have ``features``
    distinct features together.
    """
    ship_package(docs.sparkSession)
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("_label"), F.max("quality").alias("_other"))
        .where("_label = _other")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .select("doc_id", "_label")
        .limit(rows)
    )

    @F.arrow_udf("binary")
    def counted(texts: pa.Array) -> pa.Array:
        return counts_of(texts, bits)

    texts = one_text_each(docs.select("doc_id", "text"), known, "doc_id")
    counts = texts.select("doc_id", "_label", counted("text").alias("_counts"))
    sized = counts.withColumn("_size", F.octet_length("_counts") / 8)
    sample = collected(sized, "_size", features, F.xxhash64("doc_id"), "doc_id")
    chosen, truth, raw = [], [], None
    for i in pc.sort_indices(sample.column("doc_id")).to_pylist():
        raw = sample.column("_counts")[i].as_buffer()  # read where it lies: the sample is not copied
        half = raw.size // 8
        chosen.append((np.frombuffer(raw, np.int32, half), np.frombuffer(raw, np.int32, half, 4 * half)))
        truth.append(sample.column("_label")[i].as_py())
    model = fit(chosen, np.array(truth, np.int64), bits)
    del chosen, sample, raw
    pa.default_memory_pool().release_unused()
    return model


def score(docs: DataFrame, model: QualityModel, text: str = "text", name: str = "score") -> DataFrame:
    """Add the probability of label 1; a column of that name that is there already is replaced."""
    ship_package(docs.sparkSession)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(scores(texts, model))

    return docs.withColumn(name, scored(text))


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % parts
