"""Target-distribution importance resampling over hashed word features.

Features of a text are its runs of one to ``width`` consecutive words; a feature's bucket is the
CRC-32 of its bytes modulo ``buckets``. The counts of all buckets in a source and in a target
give each bucket a gain, the logarithm of how much likelier it is in the target; a text's weight
is its features' mean gain. Adding Gumbel noise drawn from the document's id to the weights and
keeping the greatest sums draws without replacement in proportion to the weights.

CRC-32 is linear over single bits: the register after a message is the exclusive or of what each
byte contributes alone, which depends on the byte and its distance from the end, and of a
constant of the length. So the features' spans are cut out of the bytes of a chunk, each byte is
looked up in a table (distance, byte), and ``bitwise_xor.reduceat`` adds the spans up. Distances
beyond the table are folded: blocks of the table's length are summed alone and then moved on by
whole powers of two of zero bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioseek.llm import batches
from folioseek.plans.shipping import ship_package
from folioseek.plans.sizing import materialize

#: What separates words, and the reflected polynomial of CRC-32.
SEPARATORS = batches.table([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
POLYNOMIAL = 0xEDB88320

#: Distances in the table; a power of two.
POSITIONS = 64
#: Bytes of spans looked up at a time.
SLICE = 1 << 18


def _position_table() -> np.ndarray:
    """Contribution of every byte at each distance from the end of its span."""
    row = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        row = (row >> np.uint32(1)) ^ np.where(row & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    rows = [row]
    while len(rows) < POSITIONS:
        rows.append((rows[-1] >> np.uint32(8)) ^ rows[0][rows[-1] & 0xFF])
    return np.stack(rows)


TABLE = _position_table()
FLAT = TABLE.ravel()


def _moves() -> list[np.ndarray]:
    """For each power of two up to 2^40, where that many zero bytes take each byte of a register."""
    registers = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32)[:, None])
    step = (registers >> np.uint32(8)) ^ TABLE[0][registers & 0xFF]
    steps = [step]
    while len(steps) <= 40:
        steps.append(_moved(steps[-1], steps[-1]))
    return steps


def _moved(step: np.ndarray, registers: np.ndarray) -> np.ndarray:
    parts = [step[i][registers >> np.uint32(8 * i) & np.uint32(0xFF)] for i in range(4)]
    return parts[0] ^ parts[1] ^ parts[2] ^ parts[3]


MOVES = _moves()


def moved(registers: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Registers after as many zero bytes each."""
    registers = registers.astype(np.uint32)
    for bit in range(int(distance.max(initial=0)).bit_length()):
        at = np.flatnonzero(distance >> bit & 1)
        registers[at] = _moved(MOVES[bit], registers[at])
    return registers


START = np.uint32(0xFFFFFFFF)
#: By length, for lengths of up to four times the table.
CONSTANTS = moved(np.full(4 * POSITIONS, START), np.arange(4 * POSITIONS)) ^ START


def _raw(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Summed contributions of the bytes of each span; spans may overlap, none is empty."""
    length = length.astype(np.int32)
    stop = np.cumsum(length, dtype=np.int32)
    first = stop - length
    place = np.arange(int(stop[-1]), dtype=np.int32)
    low = int(begin.min())
    byte = data[low : int((begin + length).max())][np.repeat((begin - low).astype(np.int32) - first, length) + place]
    distance = np.repeat(stop - 1, length) - place
    if length.max() <= POSITIONS:
        return np.bitwise_xor.reduceat(FLAT[(distance << 8) | byte], first)
    starts = (distance & (POSITIONS - 1)) == POSITIONS - 1
    starts[first] = True
    block = np.flatnonzero(starts)
    folded = np.bitwise_xor.reduceat(FLAT[((distance & (POSITIONS - 1)) << 8) | byte], block)
    folded = moved(folded, distance[block] & ~(POSITIONS - 1))
    return np.bitwise_xor.reduceat(folded, np.searchsorted(block, first))


def constants(length: np.ndarray) -> np.ndarray:
    """What the register's start and end values add to the CRC of a span of each length."""
    short = CONSTANTS[np.minimum(length, len(CONSTANTS) - 1)]
    at = np.flatnonzero(length >= len(CONSTANTS))
    if len(at):
        short[at] = moved(np.full(len(at), START), length[at]) ^ START
    return short


def span_crcs(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of every span of bytes, none of them empty."""
    length = end - begin
    total = np.concatenate([[0], np.cumsum(length)])
    found = [np.zeros(0, np.uint32)]
    low = 0
    while low < len(begin):
        high = max(low + 1, int(np.searchsorted(total, total[low] + SLICE, "right")) - 1)
        if length[low] > SLICE:
            register = np.zeros(1, np.uint32)
            for at in range(int(begin[low]), int(end[low]), SLICE):
                part = np.array([min(SLICE, int(end[low]) - at)])
                register = moved(register, part) ^ _raw(data, np.array([at]), part)
            found.append(register)
        else:
            found.append(_raw(data, begin[low:high], length[low:high]))
        low = high
    return np.concatenate(found) ^ constants(length)


def features(data: np.ndarray, offsets: np.ndarray, width: int, buckets: int):
    """For each length of a run of words, the buckets of all runs and the number of runs before each text; and words before it."""
    joined, begin, end, first = batches.joined_words(data, offsets, SEPARATORS, fold=True)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    found = []
    for w in range(1, width + 1):
        place = np.arange(max(0, len(begin) - w + 1))
        place = place[text[place] == text[place + w - 1]]
        crc = span_crcs(joined, begin[place], end[place + w - 1])
        found.append(((crc % np.uint32(buckets)).astype(np.int64), np.searchsorted(place, first)))
    return found, first


def bucket_counts(texts: DataFrame, width: int = 2, buckets: int = 10_000) -> np.ndarray:
    """Features of all texts (``text``) in each bucket.

    Every task adds up its own texts, so a row per task and bucket is shuffled; what comes to the
    driver is a number per bucket.
    """
    ship_package(texts.sparkSession)

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in parts:
            for _, _, data, offsets in batches.chunks(batch.column(0)):
                for found, _ in features(data, offsets, width, buckets)[0]:
                    counts += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["bucket", "n"])

    total = texts.select("text").mapInArrow(rows, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(buckets, np.int64)
    counts[total.column(0).to_numpy()] = total.column(1).to_numpy()
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's share in the target and in the source, one more in each bucket."""
    s, t, buckets = source.astype(float), target.astype(float), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, width: int = 2) -> DataFrame:
    """``docs`` with ``_n_words``, ``_n_features`` and ``_weight`` in place of ``text``.

    The weight is the floored mean gain of a text's features, 0 without any. A null text has no words.
    """
    spark = docs.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(gain)
    added = ["_n_words", "_n_features", "_weight"]

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for batch in parts:
            others = batch.select(list(range(1, batch.num_columns)))
            for low, high, data, offsets in batches.chunks(batch.column(0)):
                found, first = features(data, offsets, width, len(gain))
                n, total = np.zeros(high - low, np.int64), np.zeros(high - low, np.int64)
                for bucket, before in found:
                    sums = np.concatenate([[0], np.cumsum(gain[bucket])])
                    total += sums[before[1:]] - sums[before[:-1]]
                    n += np.diff(before)
                values = [np.diff(first), n, total // np.maximum(n, 1)]
                part = others.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*map(pa.array, values), *part.columns], [*added, *part.schema.names])

    names = [c for c in docs.columns if c != "text"]
    plain = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)]
    shape = docs.select(*plain).schema
    ddl = "".join(f", {f.name} {f.dataType.simpleString()}" for f in shape.fields)
    weighed = docs.select("text", *plain).mapInArrow(rows, "_n_words bigint, _n_features bigint, _weight bigint" + ddl)
    return weighed.select(*added, *[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)])


def noise(key: str, seed: int):
    """Thousandths of a Gumbel variable that hangs on the seed and the key (null: empty) alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    drawn = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0))).cast("long")


def places(df: DataFrame, *order) -> DataFrame:
    """``df`` with ``_place``: 1, 2, 3 ... in the order of columns that no two rows share.

    Rows are dealt out in ranges of the order and ranked in their range; a number per range is
    added up before, so no task holds more than a range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
        F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")
    )
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    ranked = ranged.withColumn("_rank", rank).join(F.broadcast(before), F.col("_range") == F.col("_of"))
    return ranked.withColumn("_place", F.col("_rank") + F.col("_before")).drop("_range", "_rank", "_of", "_before")


def resample(
    docs: DataFrame, target: DataFrame, seed: int, num: int, den: int, least_words: int = 20, width: int = 2, buckets: int = 10_000
) -> DataFrame:
    """One row per document (doc_id, text): doc_id, n_features, weight, score, rank.

    ``target`` (text) has the distribution to draw to. Of the documents with ``least_words`` words,
    ``num / den`` (floored) with the greatest scores are drawn and ranked, ties to the smaller id; the
    rank of all others is null. Null and empty texts have no features and weight 0; an empty table
    gives no rows. A null id draws by the empty text and comes first among ties. Repeated rows are
    rows of their own, with equal scores.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gain = gains(bucket_counts(read, width, buckets), bucket_counts(target, width, buckets))

    def numbered(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + batch.num_rows)), *batch.columns], ["_row", *batch.schema.names])
            row += batch.num_rows

    scored = weigh(read, gain, width).withColumn("score", F.col("_weight") + noise("doc_id", seed))
    ddl = "_row bigint, _n_words bigint, _n_features bigint, _weight bigint, doc_id bigint, score bigint"
    scored = materialize(scored.mapInArrow(numbered, ddl), "scores")
    fit = F.coalesce(F.col("_n_words") >= least_words, F.lit(False))
    drawn = scored.where(fit).count() * num // den
    placed = places(scored.where(fit), F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("_row").asc())
    placed = placed.withColumn("rank", F.when(F.col("_place") <= drawn, F.col("_place")).cast("long")).drop("_place")
    rest = scored.where(~fit).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(rest).select(
        "doc_id", F.col("_n_features").alias("n_features"), F.col("_weight").alias("weight"), "score", "rank"
    )
