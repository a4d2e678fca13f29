"""Arrow text columns as byte arrays, and vectorised hashes of their words.

Work goes over chunks of whole texts of a few megabytes, so memory does not follow the size
of an Arrow batch; one text longer than a chunk is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19

#: ASCII white space, odd multipliers of the hashes.
WHITE = (9, 10, 11, 12, 13, 32)
BASE = 0x9E3779B97F4A7C15
MIX = 0xD6E8FEB86659FD93
STEPS = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)

_U64 = np.uint64
_powers = np.ones(1, _U64)
_inverses = np.ones(1, _U64)


def table(members, value: bool = True) -> np.ndarray:
    found = np.full(256, not value)
    found[list(members)] = value
    return found


SPACES = table(WHITE)


def _values(fold: bool, seed: int = 20240607) -> np.ndarray:
    values = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.int64).astype(_U64) | _U64(1)
    if fold:
        values[65:91] = values[97:123]
    return values


#: Byte values for hashes that see ASCII letters alike, as they are, and a second time independently.
FOLDED, EXACT, OTHER = _values(True), _values(False), _values(False, 77)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another, and where each begins; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        offsets = np.frombuffer(column.buffers()[1], np.int64)
    else:
        offsets = np.frombuffer(column.buffers()[1], np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges ``(low, high)`` of texts with their bytes and offsets."""
    data, offsets = text_bytes(column)
    low, rows = 0, len(column)
    while low < rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1)
        high = min(high, rows)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def _grow(length: int) -> None:
    global _powers, _inverses
    if len(_powers) < length:
        size = max(length, CHUNK_BYTES + 1)
        with np.errstate(over="ignore"):
            for name, factor in (("_powers", BASE), ("_inverses", pow(BASE, -1, 2**64))):
                steps = np.full(size, factor, _U64)
                steps[0] = 1
                globals()[name] = np.cumprod(steps, dtype=_U64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U64(32))
    h = h * _U64(MIX)
    return h ^ (h >> _U64(29))


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end (exclusive) of every word; no word crosses from one text to the next."""
    inside = ~separators[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = inside[first]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[last] = inside[last]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES, values: np.ndarray = FOLDED
) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, and the number of words before each text.

    A word's hash is a polynomial in its bytes, read off one running sum over the chunk.
    """
    if not len(data):
        return np.zeros(0, _U64), np.zeros(len(offsets), np.int64)
    begin, end = word_spans(data, offsets, separators)
    return span_hashes(data, begin, end, values), np.searchsorted(begin, offsets)


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, values: np.ndarray) -> np.ndarray:
    """64-bit hash of every span of bytes."""
    _grow(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U64)
    np.cumsum(values[data] * _powers[: len(data)], out=sums[1:])
    return mixed((sums[end] - sums[begin]) * _inverses[begin])


def one_hash(word: bytes, values: np.ndarray = FOLDED) -> int:
    """The hash that ``word_hashes`` gives to a single word."""
    data = np.frombuffer(word, np.uint8)
    return int(word_hashes(data, np.array([0, len(data)]), np.zeros(256, bool), values)[0][0])


def run_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words, texts ignored; shorter by ``width - 1``."""
    count = max(0, len(hashes) - width + 1)
    total = np.zeros(count, _U64)
    for i in range(width):
        total += mixed(hashes[i : i + count] + _U64(STEPS[i % len(STEPS)])) * _U64(STEPS[(i + 1) % len(STEPS)] + 2 * i)
    return mixed(total)


def shingle_sets(
    data: np.ndarray, offsets: np.ndarray, width: int, separators: np.ndarray = SPACES
) -> list[np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text.

    A text with fewer words than ``width`` has its whole word sequence as its one shingle, a
    text without words has none.
    """
    words, first = word_hashes(data, offsets, separators)
    runs = run_hashes(words, width)
    found = []
    for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if high - low >= width:
            found.append(np.unique(runs[low : high - width + 1]))
        elif high > low:
            found.append(run_hashes(words[low:high], high - low) ^ _U64(high - low))
        else:
            found.append(np.zeros(0, _U64))
    return found


def by_offsets(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each range ``first[i]:first[i + 1]``; empty ranges are 0."""
    sums = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and where each begins."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    if before[-1] == len(points):
        return points, before[offsets]
    parts = [
        np.frombuffer(data[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        for a, b in zip(offsets[:-1], offsets[1:], strict=True)
    ]
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def gram_buckets(points: np.ndarray, offsets: np.ndarray, width: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every run of ``width`` code points that stays inside its text.

    Returns the buckets and the number of runs before each text.
    """
    count = max(0, len(points) - width + 1)
    h = np.full(count, width, _U64)
    for i in range(width):
        h = h * _U64(BASE) + points[i : i + count]
    buckets = (mixed(h) >> _U64(64 - bits)).astype(np.int32)
    if width == 1:
        return buckets, offsets
    whole = np.ones(len(points), bool)
    for i in range(1, width):
        at = offsets[1:] - i
        whole[at[at >= offsets[:-1]]] = False
    runs = np.maximum(np.diff(offsets) - width + 1, 0)
    return buckets[whole[:count]], np.concatenate([[0], np.cumsum(runs)])


def joined_words(
    data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES, fold: bool = False
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all words, one space after each; where each word begins and ends; words before each text.

    With ``fold`` ASCII capitals become small letters.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint8), none, none, np.zeros(len(offsets), np.int64)
    begin, end = word_spans(data, offsets, separators)
    length = end - begin
    new_end = np.cumsum(length + 1) - 1
    new_begin = new_end - length
    joined = np.full(int(new_end[-1]) + 1 if len(end) else 0, 32, np.uint8)
    inside = np.flatnonzero(~separators[data])
    own = data[inside]
    if fold:
        own = np.where((own >= 65) & (own <= 90), own + 32, own).astype(np.uint8)
    joined[inside + np.repeat(new_begin - begin, length)] = own
    return joined, new_begin, new_end, np.searchsorted(begin, offsets)
