"""Document fingerprints: quartile digests of byte triplet counts.

Triplets of near bytes of the UTF-8 text are hashed into 256 buckets and counted. A digest
holds, in hexadecimal, two bits per bucket that tell between which quartiles of all counts its
count lies, the length on a logarithmic scale, and the ratios of the quartiles. The difference
of two digests sums the steps between bucket codes, lengths and ratios, and is bounded, so
likeness runs from 0 to 1. Equal texts have equal digests; a text of under 3 bytes has no
triplet, and its digest tells its length alone.

``compare_with_next`` also edits every document, with text of the next one by id, and compares
digests. Documents are range-partitioned by id once; a task streams its sorted rows holding two
documents. The first and last document of each partition are paired up in a second, small step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioseek.llm import batches
from folioseek.plans.shipping import ship_package
from folioseek.plans.sizing import materialize

BUCKETS = 256
#: Places of the three bytes of a triplet, from its first.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
#: A length grows by this factor from one step of its scale to the next.
LENGTH_STEP = 1.15
#: Weight of one step of length, of one step of a quartile ratio, and the difference that counts as wholly unlike.
LENGTH_WEIGHT, RATIO_WEIGHT, UNLIKE = 3, 1, 320

_tables = np.random.default_rng(4041).permuted(np.tile(np.arange(256, dtype=np.uint8), (9, 1)), axis=1)


def digests(texts: pa.Array) -> list[str]:
    """Digest of each text; null counts as empty."""
    found: list[str] = []
    for _, _, data, offsets in batches.chunks(texts):
        rows = len(offsets) - 1
        counts = np.zeros((rows, BUCKETS), np.int64)
        sizes = np.diff(offsets)
        for k, (a, b, c) in enumerate(TRIPLETS):
            width = c + 1
            if len(data) < width:
                continue
            t1, t2, t3 = _tables[3 * k : 3 * k + 3]
            stop = len(data) - c
            bucket = t1[data[a : a + stop]] ^ t2[data[b : b + stop]] ^ t3[data[c:]]
            for i in range(rows):
                if sizes[i] >= width:
                    counts[i] += np.bincount(bucket[offsets[i] : offsets[i + 1] - c], minlength=BUCKETS)
        ranked = np.sort(counts, axis=1)
        quartiles = ranked[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
        codes = (counts[:, :, None] > quartiles[:, None, :]).sum(axis=2).astype(np.uint8)
        packed = codes[:, 0::4] | codes[:, 1::4] << 2 | codes[:, 2::4] << 4 | codes[:, 3::4] << 6
        length = np.minimum(255, np.round(np.log1p(sizes) / np.log(LENGTH_STEP))).astype(np.uint8)
        top = np.maximum(quartiles[:, 2], 1)
        ratios = (quartiles[:, 0] * 15 // top) << 4 | (quartiles[:, 1] * 15 // top)
        whole = np.concatenate([length[:, None], ratios.astype(np.uint8)[:, None], packed], axis=1)
        found += [row.tobytes().hex() for row in whole]
    return found


def likeness(ours: list[str], theirs: list[str]) -> np.ndarray:
    """1 for equal digests down to 0 for a difference of ``UNLIKE`` or more."""
    if not ours:
        return np.zeros(0)
    a, b = (np.frombuffer(bytes.fromhex("".join(x)), np.uint8).reshape(len(x), -1).astype(np.int16) for x in (ours, theirs))
    difference = LENGTH_WEIGHT * np.abs(a[:, 0] - b[:, 0])
    for shift in (0, 4):
        difference += RATIO_WEIGHT * np.abs((a[:, 1] >> shift & 15) - (b[:, 1] >> shift & 15))
    for shift in (0, 2, 4, 6):
        steps = np.abs((a[:, 2:] >> shift & 3) - (b[:, 2:] >> shift & 3))
        difference += np.where(steps == 3, 6, steps).sum(axis=1, dtype=np.int16)
    return 1 - np.minimum(difference, UNLIKE) / UNLIKE


def edited(text: str, following: str) -> str:
    """The last half of ``text`` replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])
EDGE = pa.schema([*RESULT, ("part", pa.int32()), ("edge", pa.string()), ("text", pa.string())])
EDGE_DDL = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, part int, edge string, text string"
)


def compared(ids: list, texts: list[str], marks: list[str], following: list[str], next_marks: list[str]) -> dict:
    """Result columns of documents whose following documents are known."""
    new = [edited(a, b) for a, b in zip(texts, following, strict=True)]
    new_marks = digests(pa.array(new, pa.large_string()))
    return {
        "doc_id": ids,
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in new],
        "fingerprint": marks,
        "edited_fingerprint": new_marks,
        "near_edited": likeness(marks, new_marks),
        "near_next": likeness(marks, next_marks),
    }


def _stream(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each row of a sorted partition with the next; first and last come out as edges."""
    part = TaskContext.get().partitionId()

    def rows(columns: dict, edge: str | None = None, text: str | None = None) -> pa.RecordBatch:
        n = len(columns["doc_id"])
        columns = columns | {"part": [part] * n, "edge": [edge] * n, "text": [text] * n}
        return pa.RecordBatch.from_pydict({f.name: columns.get(f.name, [None] * n) for f in EDGE}, EDGE)

    held: tuple | None = None
    for batch in parts:
        for low in range(0, batch.num_rows, 256):
            cut = batch.slice(low, 256)
            ids, texts = cut.column("doc_id").to_pylist(), cut.column("text").fill_null("").to_pylist()
            marks = digests(cut.column("text"))
            if held is None:
                yield rows({"doc_id": ids[:1], "fingerprint": marks[:1]}, "first", texts[0])
            else:
                ids, texts, marks = [held[0], *ids], [held[1], *texts], [held[2], *marks]
            if len(ids) > 1:
                yield rows(compared(ids[:-1], texts[:-1], marks[:-1], texts[1:], marks[1:]))
            held = ids[-1], texts[-1], marks[-1]
    if held is not None:
        yield rows({"doc_id": [held[0]], "fingerprint": [held[2]]}, "last", held[1])


def compare_with_next(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Fingerprints of every document, of its edited text, and how near they are.

    ``docs``: doc_id, text. Documents follow each other by id, null ids first, equal ids by
    text; after the last comes the first, so a single document follows itself. One row comes
    out for each that goes in.
    """
    spark = docs.sparkSession
    ship_package(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(n, "doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    found = materialize(ordered.mapInArrow(_stream, EDGE_DDL), "fingerprints")
    names = RESULT.names
    inner = found.where("edge is null").select(names)

    edges = found.where("edge is not null")
    firsts = edges.where("edge = 'first'").select(
        F.col("part").alias("_next"), F.col("text").alias("_text"), F.col("fingerprint").alias("_mark")
    )
    order = Window.orderBy("part")
    after = edges.where("edge = 'first'").select(
        "part",
        F.coalesce(F.lead("part").over(order), F.min("part").over(order)).alias("_next"),
    )

    def resolve(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for i in range(b.num_rows):
                ids, texts, marks, following, next_marks = (b.slice(i, 1).column(c).to_pylist() for c in range(5))
                yield pa.RecordBatch.from_pydict(compared(ids, texts, marks, following, next_marks), RESULT)

    ddl = EDGE_DDL.split(", part")[0]
    outer = (
        edges.where("edge = 'last'")
        .select("part", "doc_id", "text", "fingerprint")
        .join(after, "part")
        .join(firsts, "_next")
        .select("doc_id", "text", "fingerprint", "_text", "_mark")
        .mapInArrow(resolve, ddl)
    )
    return inner.unionByName(outer)
