"""Token ids of documents in binary segments, with Elias-Fano coded boundaries.

A segment holds consecutive documents by ascending id: their concatenated token ids (2 bytes
each if the vocabulary allows, else 4), the ends of the documents in them, and the document
ids. Ends and document ids are non-decreasing and stored in Elias-Fano form: the low bits of
every value packed, the high bits as gaps in unary, which takes about 2 + log2(range / n) bits
a value; sampled positions of the unary ones make a look-up of one value need a short scan and
no table of 64-bit offsets.

Segments are the rows of a Parquet table, so that Spark's writers commit them whole: lost
executors leave no half-written ones.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioseek.llm import batches
from folioseek.llm.joins import lookup
from folioseek.plans.shipping import ship_package

MAGIC = b"EFTOKEN1"
SAMPLE = 256
#: A segment is closed once it holds so many ids; one document is never split.
SEGMENT_IDS = 1 << 20
#: Distinct pieces of text whose ids a worker remembers.
REMEMBERED = 1 << 20
#: Bytes of text encoded at a time; more makes fewer insertions into what is remembered.
ENCODED_TOGETHER = 1 << 20


@dataclass(frozen=True)
class EliasFano:
    """A non-decreasing sequence of integers, from ``base`` on."""

    n: int
    base: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    samples: np.ndarray

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        if not n:
            none = np.zeros(0, np.uint8)
            return cls(0, 0, 0, none, none, np.zeros(0, np.uint32))
        base = int(values[0])
        away = values.astype(np.uint64) - np.uint64(base % 2**64)
        low_bits = max(0, int(away[-1]) // n).bit_length() - 1
        low_bits = max(0, low_bits)
        bits = (away[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        ones = (away >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1, np.uint8)
        unary[ones] = 1
        return cls(
            n, base, low_bits, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"),
            np.packbits(unary, bitorder="little"), ones[::SAMPLE].astype(np.uint32),
        )

    def select(self, i: int) -> int:
        """The value at place ``i``, read from its few bytes alone."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, at // 8
        skip = at % 8
        while True:
            bits = int(self.high[byte]) >> skip << skip
            ones = bits.bit_count()
            if left < ones:
                break
            left, byte, skip = left - ones, byte + 1, 0
        for _ in range(left):
            bits &= bits - 1
        one = byte * 8 + (bits & -bits).bit_length() - 1
        first = i * self.low_bits
        raw = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little")
        return self.base + ((one - i) << self.low_bits | raw >> first % 8 & (1 << self.low_bits) - 1)

    def all(self) -> np.ndarray:
        """Every value, as int64."""
        if not self.n:
            return np.zeros(0, np.int64)
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        low = np.zeros(self.n, np.uint64)
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, -1)
            low = (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return (high + low + np.uint64(self.base % 2**64)).astype(np.int64)

    def to_bytes(self) -> bytes:
        head = struct.pack("<QqBQQQ", self.n, self.base, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, raw: memoryview, at: int = 0) -> tuple[EliasFano, int]:
        n, base, low_bits, low, high, samples = struct.unpack_from("<QqBQQQ", raw, at)
        at += struct.calcsize("<QqBQQQ")
        a = np.frombuffer(raw, np.uint8, low, at)
        b = np.frombuffer(raw, np.uint8, high, at + low)
        c = np.frombuffer(raw, "<u4", samples, at + low + high)
        return cls(n, base, low_bits, a, b, c), at + low + high + 4 * samples


@dataclass(frozen=True)
class Segment:
    """Consecutive documents: their ids (null ids first), the ends of their tokens, the tokens."""

    nulls: int
    keys: EliasFano
    ends: EliasFano
    ids: np.ndarray

    def to_bytes(self) -> bytes:
        head = MAGIC + struct.pack("<BQQ", self.ids.dtype.itemsize, self.nulls, len(self.ids))
        return head + self.keys.to_bytes() + self.ends.to_bytes() + self.ids.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Segment:
        if raw[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token segment")
        view = memoryview(raw)
        width, nulls, n = struct.unpack_from("<BQQ", view, len(MAGIC))
        keys, at = EliasFano.from_bytes(view, len(MAGIC) + struct.calcsize("<BQQ"))
        ends, at = EliasFano.from_bytes(view, at)
        return cls(nulls, keys, ends, np.frombuffer(view, f"<u{width}", n, at))

    def __len__(self) -> int:
        return self.ends.n

    def document(self, i: int) -> np.ndarray:
        """Token ids of the document at place ``i``."""
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + self.keys.all().tolist()


class Encoder:
    """Token ids of texts by a tokenizer file, encoding each distinct piece of text once.

    A byte-level tokenizer of this kind cuts texts into pieces before it merges bytes, a space
    belongs to the word after it, and a line end between two words is a piece. So a text in
    which no two white-space characters meet may be cut before each space and around each line
    end; its ids are those of the pieces one after another. Other texts are encoded whole, and
    so are those that hold an added token of the file, which is one id by the library's default.
    Known pieces are found by two 64-bit hashes.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if self.tokenizer.normalizer is not None and any(t.normalized for t in added):
            raise ValueError("this tokenizer finds added tokens in changed text")
        self.added = [t.content.encode() for t in added if t.content]
        self.line_end = self._whole("\n")
        if len(self.line_end) != 1:
            raise ValueError("this tokenizer does not encode a line end as one id")
        self.start_over()

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def start_over(self) -> None:
        self.keys, self.checks, self.places = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        # place 0 is the line end, then the tails
        known = [self.line_end, *(self._whole(chr(t)) for t in TAILS)]
        self.flat = np.array([i for ids in known for i in ids], np.uint32)
        self.first = np.concatenate([[0], np.cumsum([len(ids) for ids in known])])

    def _learn(self, pieces: list[str]) -> np.ndarray:
        """Encode pieces, which hold no line end, and return their places."""
        for low in range(0, len(pieces), 20_000):
            group = pieces[low : low + 20_000]
            ids = np.array(self._whole("\n".join(group)), np.uint32)
            cut = np.flatnonzero(ids == self.line_end[0])
            if len(cut) == len(group) - 1:
                sizes = np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1
                ids = np.delete(ids, cut)
            else:
                found = [e.ids for e in self.tokenizer.encode_batch_fast(group, add_special_tokens=False)]
                sizes = np.array([len(f) for f in found])
                ids = np.array([i for f in found for i in f], np.uint32)
            self.flat = np.concatenate([self.flat, ids])
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
        return np.arange(len(self.first) - 1 - len(pieces), len(self.first) - 1)

    def _places(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, spaced: np.ndarray) -> np.ndarray:
        """Place of each word's piece, learning the new ones."""
        mark = np.where(spaced, np.uint64(batches.STEPS[0]), np.uint64(batches.STEPS[1]))
        keys = batches.mixed(batches.span_hashes(data, begin, end, batches.EXACT) ^ mark)
        checks = batches.span_hashes(data, begin, end, batches.OTHER) ^ mark
        own, at, back = np.unique(keys, return_index=True, return_inverse=True)
        if np.any(checks != checks[at][back]):  # two pieces with one key in one chunk: tell them apart by hand
            pieces = [self._piece(data, *x) for x in zip(begin, end, spaced, strict=True)]
            return self._learn(pieces)
        where = np.minimum(np.searchsorted(self.keys, own), max(0, len(self.keys) - 1))
        known = (self.keys[where] == own) & (self.checks[where] == checks[at]) if len(self.keys) else np.zeros(len(own), bool)
        places = np.empty(len(own), np.int64)
        places[known] = self.places[where[known]]
        new = np.flatnonzero(~known)
        if len(new):
            places[new] = self._learn([self._piece(data, begin[i], end[i], spaced[i]) for i in at[new].tolist()])
            clash = self.keys[where[new]] == own[new] if len(self.keys) else np.zeros(len(new), bool)
            new = new[~clash]
            to = np.searchsorted(self.keys, own[new])
            self.keys = np.insert(self.keys, to, own[new])
            self.checks = np.insert(self.checks, to, checks[at][new])
            self.places = np.insert(self.places, to, places[new])
        return places[back]

    @staticmethod
    def _piece(data: np.ndarray, begin: int, end: int, spaced: bool) -> str:
        return (" " if spaced else "") + data[begin:end].tobytes().decode("utf-8", "replace")

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int) -> list[np.ndarray]:
        """Ids of each text of a chunk, with ``end`` appended."""
        if len(self.keys) > REMEMBERED:
            self.start_over()
        uneven = uneven_texts(data, offsets) | holding_texts(data, offsets, self.added)
        found: list[np.ndarray] = []
        begin, stop = batches.word_spans(data, offsets, BREAKS) if len(data) else (np.zeros(0, np.int64),) * 2
        first = np.searchsorted(begin, offsets)
        rows = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        kept = ~uneven[rows]
        begin, stop, rows = begin[kept], stop[kept], rows[kept]
        opens = np.ones(len(begin), bool)
        opens[1:] = rows[1:] != rows[:-1]
        before = data[np.maximum(begin - 1, 0)] if len(data) else np.zeros(0, np.uint8)
        spaced = ~opens & (before == 32)
        broken = ~opens & (before == 10)
        # a point or comma after an ASCII letter or digit at the end of a word is a piece
        tail = np.searchsorted(TAILS, data[stop - 1]) if len(stop) else np.zeros(0, np.int64)
        tailed = (stop - begin > 1) & TAIL[data[stop - 1]] & ALNUM[data[np.maximum(stop - 2, 0)]] if len(stop) else tail > 0
        behind = np.cumsum(1 + broken + tailed)
        units = np.zeros(int(behind[-1]) if len(behind) else 0, np.int64)
        units[behind - 1 - tailed] = self._places(data, begin, stop - tailed, spaced)
        units[behind[tailed] - 1] = 1 + tail[tailed]
        sizes = self.first[units + 1] - self.first[units]
        ends = np.cumsum(sizes)
        ids = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[units] - ends + sizes, sizes)]
        words = np.searchsorted(rows, np.arange(len(offsets) - 1), "right")  # up to each text's end
        upto = np.concatenate([[0], ends])[np.concatenate([[0], behind])[words]]
        low = 0
        for i, high in enumerate(upto.tolist()):
            if uneven[i]:
                own = self._whole(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
                found.append(np.array([*own, end], np.uint32))
            else:
                found.append(np.append(ids[low:high], np.uint32(end)))
            low = high
        return found


#: Bytes that texts are cut at, those that are cut off words, ASCII letters and digits, white space.
BREAKS = batches.table((10, 32))
TAILS = np.array([44, 46], np.uint8)
TAIL = batches.table(TAILS.tolist())
ALNUM = batches.table((*range(48, 58), *range(65, 91), *range(97, 123)))
WHITE = batches.table((*range(9, 14), *range(28, 33)))


def uneven_texts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts that begin or end with white space, hold two in a row, or white space beyond ASCII."""
    texts = len(offsets) - 1
    found = np.zeros(texts, bool)
    if not len(data):
        return found
    white = WHITE[data]
    twice = np.flatnonzero(white[1:] & white[:-1])
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    lead = lead[lead + 2 < len(data) + (data[lead] == 0xC2)]
    a, b = data[lead], data[lead + 1]
    c = data[np.minimum(lead + 2, len(data) - 1)]
    wide = lead[
        ((a == 0xC2) & ((b == 0x85) | (b == 0xA0)))
        | ((a == 0xE1) & (b == 0x9A) & (c == 0x80))
        | ((a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)))
        | ((a == 0xE2) & (b == 0x81) & (c == 0x9F))
        | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    ]
    for at in (twice, wide):
        row = np.searchsorted(offsets, at, "right") - 1
        found[row] = True
    some = offsets[:-1] < offsets[1:]
    found[some] |= white[offsets[:-1][some]] | white[offsets[1:][some] - 1]
    return found


def holding_texts(data: np.ndarray, offsets: np.ndarray, wanted: list[bytes]) -> np.ndarray:
    """Texts that hold one of the wanted byte strings."""
    found = np.zeros(len(offsets) - 1, bool)
    raw = data.tobytes()
    for own in wanted:
        at = raw.find(own)
        while at >= 0:
            row = int(np.searchsorted(offsets, at, "right")) - 1
            inside = at + len(own) <= offsets[row + 1]
            found[row] |= inside
            at = raw.find(own, int(offsets[row + 1]) if inside else at + 1)
    return found


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def width_of(path: str, end: int) -> int:
    return 2 if max(encoder(path).tokenizer.get_vocab_size() - 1, end) < 1 << 16 else 4


def write(docs: DataFrame, path: str, tokenizer: str, end: int, partitions: int | None = None) -> None:
    """Write the documents (doc_id, text) as segments into the folder ``path``.

    Documents come in ascending id, null ids first, equal ids by their text. A null text
    is empty and has the end id alone. ``tokenizer`` is a file that every executor can read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = width_of(tokenizer, end)

    def packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        raw: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            known = np.array([k for k in keys if k is not None], np.int64)
            ends = np.cumsum([len(r) // width for r in raw], dtype=np.int64)
            ids = np.frombuffer(b"".join(raw), f"<u{width}")
            segment = Segment(len(keys) - len(known), EliasFano.encode(known), EliasFano.encode(ends), ids)
            return pa.RecordBatch.from_pydict(
                {"segment": [part << 32 | seq], "n_docs": [len(keys)], "n_ids": [len(ids)], "data": [segment.to_bytes()]}
            )

        own = encoder(tokenizer)
        for batch in parts:
            ids = batch.column(0).to_pylist()
            for low, high, data, offsets in batches.chunks(batch.column(1), ENCODED_TOGETHER):
                for key, found in zip(ids[low:high], own.encode(data, offsets, end), strict=True):
                    keys.append(key)
                    raw.append(found.astype(f"<u{width}").tobytes())
                    size += len(found)
                    if size >= SEGMENT_IDS:
                        yield flush()
                        keys, raw, size, seq = [], [], 0, seq + 1
        if keys:
            yield flush()

    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(n, "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(packed, "segment bigint, n_docs bigint, n_ids bigint, data binary")
        .write.parquet(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per stored document: doc_id, start, n_tokens, ids_crc32, and its segment.

    ``start`` counts the ids of all documents before it; ``ids_crc32`` is that of all its ids as
    little-endian 32-bit integers.
    """
    ship_package(spark)
    segments = spark.read.parquet(path)

    def unpacked(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                segment = Segment.from_bytes(raw)
                wide = memoryview(segment.ids.astype("<u4")).cast("B")
                ends = segment.ends.all()
                starts = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "segment": pa.array([key] * len(segment), pa.int64()),
                    "doc_id": pa.array(segment.doc_ids(), pa.int64()),
                    "_local": pa.array(starts, pa.int64()),
                    "n_tokens": pa.array(ends - starts, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                })

    sizes = segments.select("segment", F.shiftright("segment", 32).alias("_part"), "n_ids")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        sizes.groupBy("_part").agg(F.sum("n_ids").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("_part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sizes.withColumn("_inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
        .join(parts, "_part")
        .select("segment", (F.col("_before") + F.col("_inside")).alias("_base"))
    )
    rows = segments.select("segment", "data").mapInArrow(
        unpacked, "segment bigint, doc_id bigint, _local bigint, n_tokens bigint, ids_crc32 bigint"
    )
    return lookup(rows, starts, "segment", "inner").select(
        "doc_id", (F.col("_base") + F.col("_local")).alias("start"), "n_tokens", "ids_crc32", "segment"
    )
