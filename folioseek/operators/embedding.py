"""Text to vectors: an offline hashing model, or any model behind a function."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioseek.plans.shipping import ship_package

DIMENSIONS = 384

Model = Callable[[list[str]], Sequence[Sequence[float]]]
Embedder = Callable[[DataFrame, str], DataFrame]


def hashing_embedder(dim: int = DIMENSIONS) -> Embedder:
    """Hashed word counts of unit length; runs in the JVM and needs no model."""

    def embed(df: DataFrame, column: str) -> DataFrame:
        words = RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"[^\p{L}\p{N}]+")
        counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dim)
        unit = Normalizer(inputCol="_counts", outputCol="_unit", p=2.0)
        out = df.withColumn("_text", F.coalesce(F.col(column), F.lit("")))
        for stage in (words, counts, unit):
            out = stage.transform(out)
        vector = vector_to_array("_unit", "float32")
        return out.withColumns({
            "embedding": F.when(F.col(column).isNotNull(), vector),
            "embedding_error": F.lit(None).cast("string"),
        }).drop("_text", "_words", "_counts", "_unit")

    return embed


def model_embedder(
    factory: Callable[[], Model],
    dim: int = DIMENSIONS,
    spread: Sequence[str] = (),
    batch_size: int = 256,
    attempts: int = 3,
    wait: float = 0.5,
    failures: int = 64,
) -> Embedder:
    """A model called with at most ``batch_size`` texts; ``factory`` opens one client per task.

    A call that raises is made up to ``attempts`` times, ``wait`` seconds apart and twice as long
    each time. A batch that still fails, or comes back short, is halved until the failing texts
    stand alone: those get a null embedding and a message, the others keep theirs. After
    ``failures`` failed calls a task takes the model for down: the rest of that batch gets the
    last message without further calls, and so does every later batch whose first call fails.
    ``spread`` names columns to repartition by first, so that the chunks of one long document are
    embedded by many tasks.
    """
    import time

    Found = list[tuple[Sequence[float] | None, str | None]]

    class Caller:
        def __init__(self) -> None:
            self.model, self.left, self.message = factory(), failures, ""

        def batch(self, texts: list[str]) -> Found:
            if self.left <= 0:
                self.left = 1  # one call shows whether the model is back
            found = self.halved(texts)
            if all(message is None for _, message in found):
                self.left = failures
            return found

        def halved(self, texts: list[str]) -> Found:
            for attempt in range(attempts):
                if self.left <= 0:
                    return [(None, self.message)] * len(texts)
                try:
                    vectors = list(self.model(texts))
                    break
                except Exception as error:
                    self.message = str(error) or type(error).__name__
                    self.left -= 1
                    if attempt + 1 < attempts and self.left > 0:
                        time.sleep(wait * 2**attempt)
            else:
                vectors = None
            if vectors is not None:
                if len(vectors) == len(texts):
                    return [
                        (v, None) if len(v) == dim else (None, f"expected {dim} dimensions, not {len(v)}") for v in vectors
                    ]
                self.message = f"{len(vectors)} vectors for {len(texts)} segments"
            if len(texts) == 1:
                return [(None, self.message)]
            half = len(texts) // 2
            return self.halved(texts[:half]) + self.halved(texts[half:])

    def embed(df: DataFrame, column: str) -> DataFrame:
        ship_package(df.sparkSession)
        schema = T.StructType([
            *df.schema.fields,
            T.StructField("embedding", T.ArrayType(T.FloatType())),
            T.StructField("embedding_error", T.StringType()),
        ])

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            caller = Caller()
            for batch in batches:
                values = batch.column(column).to_pylist()
                present = [i for i, v in enumerate(values) if v is not None]
                found = []
                for low in range(0, len(present), batch_size):
                    found += caller.batch([values[i] for i in present[low : low + batch_size]])
                vectors: list = [None] * len(values)
                errors: list = [None] * len(values)
                for i, (vector, error) in zip(present, found):
                    vectors[i] = None if vector is None else [float(x) for x in vector]
                    errors[i] = error
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())],
                    names=[f.name for f in schema.fields],
                )

        return (df.repartition(*spread) if spread else df).mapInArrow(scan, schema)

    return embed


def embed_queries(requests: DataFrame, embedder: Embedder, key: str = "request_id") -> DataFrame:
    """Valid search requests as query vectors: ``(query_id, q, top_k)``."""
    valid = requests.filter(F.col("status") == "OK").select(F.col(key).alias("query_id"), "query", "top_k")
    return embedder(valid, "query").select("query_id", F.col("embedding").alias("q"), "top_k")
