"""Splitting documents into overlapping chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioseek.plans import sizing
from folioseek.plans.shipping import ship_package

CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
FLUSH_CHARS = 2_000_000

# What joins the pieces of each level back.
GLUES = ("\n\n", "\n", " ", " ")
SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def lines(text: str) -> list[str]:
    """Lines without the white space around them, blank ones left out."""
    return [line for part in text.split("\n") if (line := part.strip())]


def paragraphs(text: str) -> list[str]:
    """Runs of lines between blank lines; the lines inside keep their ends."""
    found: list[list[str]] = [[]]
    for line in text.split("\n"):
        if line.strip():
            found[-1].append(line)
        elif found[-1]:
            found.append([])
    return ["\n".join(p).strip() for p in found if p]


def sentences(text: str) -> list[str]:
    return SENTENCE_END.split(text)


def plain_words(text: str) -> list[str]:
    return text.split()


LEVELS: tuple[Callable[[str], list[str]], ...] = (paragraphs, lines, sentences, plain_words)

Splitter = Callable[[str], list[str]]


def closing_sentences(text: str, limit: int) -> str:
    """The longest run of whole sentences at the end of ``text`` within ``limit`` characters."""
    taken = ""
    for sentence in reversed(SENTENCE_END.split(text)):
        longer = f"{sentence} {taken}" if taken else sentence
        if len(longer) > limit:
            break
        taken = longer
    return taken


def split_text(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, level: int = 0) -> list[str]:
    """Chunks of at most ``size`` characters, cut at the largest boundary that allows it.

    Paragraphs, lines, sentences, words and at last characters are tried in turn. A chunk
    starts with the closing sentences of the one before, as far as they fit ``overlap``.
    """
    if level == len(LEVELS):
        return [text[i : i + size] for i in range(0, len(text), size)]
    cut, glue = LEVELS[level], GLUES[level]
    chunks: list[str] = []
    lead = current = ""
    for piece in filter(None, cut(text.strip())):
        if current and len(current) + len(glue) + len(piece) <= size:
            current += glue + piece
            continue
        if current and current != lead:
            chunks.append(current)
            lead = closing_sentences(current, overlap)
        if lead and len(lead) + len(glue) + len(piece) <= size:
            current = lead + glue + piece
        elif len(piece) <= size:
            lead, current = "", piece
        else:
            chunks += split_text(piece, size, overlap, level + 1)
            lead = current = closing_sentences(chunks[-1], overlap)
    if current and current != lead:
        chunks.append(current)
    return chunks


def split_windows(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[str]:
    """Fixed windows, as ``window_chunks`` cuts them natively."""
    return [text[i : i + size] for i in range(0, max(len(text) - overlap, 1), size - overlap)] if text else []


def chunk_documents(
    docs: DataFrame,
    splitter: Splitter = split_text,
    key: str = "doc_id",
    column: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """``(key, *carry, chunk_index, content, error)``, one row per chunk.

    A document whose splitter raises yields one row with the message in ``error``; the others
    go on. Chunks leave a task in bounded batches, so a long document is never held twice.
    """
    ship_package(docs.sparkSession)
    kept = sizing.fill_cores(docs.select(key, *carry, column), key)
    fields = [kept.schema[c] for c in (key, *carry)]
    schema = T.StructType([
        *fields,
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("content", T.StringType()),
        T.StructField("error", T.StringType()),
    ])

    def pieces(text: str | None) -> list[tuple[int | None, str | None, str | None]]:
        try:
            return [(i, chunk, None) for i, chunk in enumerate(splitter(text or ""))]
        except Exception as failure:
            return [(None, None, str(failure) or type(failure).__name__)]

    def flushed(batch: pa.RecordBatch, rows: list[int], found: list[tuple]) -> pa.RecordBatch:
        source = batch.select([key, *carry]).take(pa.array(rows, pa.int64()))  # not the text once per chunk
        index, content, error = zip(*found)
        return pa.RecordBatch.from_arrays(
            [
                *[source.column(c) for c in (key, *carry)],
                pa.array(index, pa.int32()),
                pa.array(content, pa.string()),
                pa.array(error, pa.string()),
            ],
            names=[f.name for f in schema.fields],
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found, held = [], [], 0
            for row, value in enumerate(batch.column(column)):
                for piece in pieces(value.as_py()):
                    rows.append(row)
                    found.append(piece)
                    held += len(piece[1] or "")
                    if held >= FLUSH_CHARS:
                        yield flushed(batch, rows, found)
                        rows, found, held = [], [], 0
            if rows:
                yield flushed(batch, rows, found)

    return kept.mapInArrow(scan, schema)


def window_chunks(
    docs: DataFrame,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    key: str = "doc_id",
    column: str = "text",
) -> DataFrame:
    """Fixed windows of ``size`` characters every ``size - overlap``, all native.

    One regular expression cuts the text into strides and windows are put together from
    neighbouring strides, so the work grows linearly with the text.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap is at least 0 and less than size")
    stride = size - overlap
    per_window = -(-size // stride)
    strides = F.regexp_extract_all(F.col(column), F.lit(f"(?s).{{1,{stride}}}"), F.lit(0))
    last = F.floor(F.greatest(F.length(column) - (overlap + 1), F.lit(0)) / stride).cast("int")

    def window(i: Column) -> Column:
        return F.substring(F.array_join(F.slice("_strides", i + 1, F.lit(per_window)), ""), 1, size)

    return (
        sizing.fill_cores(docs.select(key, column), key)
        .filter(F.length(column) > 0)
        .select(key, strides.alias("_strides"), last.alias("_last"))
        .select(key, F.posexplode(F.transform(F.sequence(F.lit(0), "_last"), window)).alias("chunk_index", "content"))
    )
