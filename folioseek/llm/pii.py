"""Personal data: pattern matches, and spans added by a skip-chain conditional random field.

Base spans are matches of four patterns (email, ip, card, phone). The random field labels
words. Only words with a digit or ``@`` can carry a label; all others are fixed to "outside",
so the graph of a document falls into small parts and messages need only run over such words.
Neighbouring words share a chain potential; distant words that are equal, or equal in their
digits, share a skip potential that rewards equal labels. Loopy sum-product message passing
gives each word's label probabilities, and words that carry a label with high probability
outside all base spans become further spans of that kind.

Weights are trained by pseudo-likelihood on a bounded sample of documents, in which the base
spans of the patterns are the labels.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioseek.llm import batches
from folioseek.llm.samples import collected, one_text_each
from folioseek.plans.shipping import ship_package

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)
#: Bounds of the documents that training reads, and of their words with a digit or ``@`` together.
TRAIN_ROWS, TRAIN_WORDS = 4000, 200_000
SURE = 0.95
DAMPING = 0.5
#: A message stands still once it changes by less. After ``ROUNDS`` rounds, parts of the graph that still move get
#: ``ROUNDS`` more for each of their edges, so that messages that swing for ever end.
TOLERANCE, ROUNDS = 1e-6, 64
EPOCHS, RATE, PENALTY = 200, 0.5, 1e-4

#: Fixed patterns.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]

_MARKS = batches.table((*range(48, 58), 64))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def emails(word: str, at: int) -> list[Span]:
    """Leftmost matches inside a word that begins at ``at``; each ``@`` is looked at once."""
    found, free, sign = [], 0, word.find("@")
    while sign >= 0:
        begin = sign
        while begin > free and LOCAL.match(word, begin - 1):
            begin -= 1
        match = DOMAIN.match(word, sign) if begin < sign else None
        if match:
            found.append(("email", at + begin, at + match.end()))
        free = match.end() if match else sign + 1
        sign = word.find("@", free)
    return found


def base_spans(text: str, words: list[tuple[int, int]]) -> list[Span]:
    """Spans of the four patterns, by kind and start; ``words`` are those with a digit or ``@``."""
    email, ip = [], []
    for a, b in words:
        word = text[a:b]
        if "@" in word:
            email += emails(word, a)
        if word.count(".") > 2:
            for m in IP.finditer(word):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                    ip.append(("ip", a + m.start(), a + m.end()))
    card = []
    phone = []
    if words:
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m.group().replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    card.append(("card", m.start(), m.end()))
        for m in PHONE.finditer(text):
            if 9 <= len(DIGIT.findall(m.group())) <= 15:
                phone.append(("phone", m.start(), m.end()))
    return email + ip + card + phone


def marked_words(texts: pa.Array):
    """For each text: the text, and code point spans of its words that have a digit or ``@``."""
    for low, high, data, offsets in batches.chunks(texts):
        begin, end = batches.word_spans(data, offsets, batches.SPACES) if len(data) else (np.zeros(0, int),) * 2
        marks = np.concatenate([[0], np.cumsum(_MARKS[data])])
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        kept = marks[end] > marks[begin]
        begin, end = begin[kept], end[kept]
        first = np.searchsorted(begin, offsets)
        own = texts.slice(low, high - low).fill_null("").to_pylist()
        for i, text in enumerate(own):
            shift = points[offsets[i]]
            a, b = begin[first[i] : first[i + 1]], end[first[i] : first[i + 1]]
            yield text, list(zip((points[a] - shift).tolist(), (points[b] - shift).tolist(), strict=True))


def described(text: str, a: int, b: int) -> list[int]:
    """Indices of the features that hold for a word, taken without the punctuation around it."""
    word = text[a:b].strip(",;:!?\"'<>[]{}|#$%&*").rstrip(".")
    digits = sum(c.isdigit() and c.isascii() for c in word)
    letters = sum(c.isalpha() for c in word)
    sign = word.find("@")
    found = [
        0,
        1 if sign > 0 else 2,
        3 if sign > 0 and "." in word[sign:].strip(".") else 4,
        5 + min(word.count("."), 4),
        10 if letters else 11,
        12 if word.startswith("+") else 13,
        14 if "(" in word or ")" in word else 15,
        16 if "-" in word else 17,
        18 + min(5, digits // 3 if digits < 13 else 5),
    ]
    parts = word.split(".")
    if len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts):
        return [*found, 24]
    if 13 <= digits <= 19 and not letters:
        plain = "".join(c for c in word if c.isdigit() and c.isascii())
        return [*found, 25 if luhn(plain) else 26]
    return found


#: Features of a word.
WIDTH = 27


@dataclass(frozen=True)
class Graph:
    """Marked words of many documents: features, chain edges, skip edges."""

    features: np.ndarray  # words x WIDTH
    chain: np.ndarray  # edges x 2, in text order
    skip: np.ndarray


@dataclass(frozen=True)
class Field:
    unary: np.ndarray  # WIDTH x LABELS
    chain: np.ndarray  # LABELS x LABELS
    skip: float


def graph(docs: list[tuple[str, list[tuple[int, int]]]]) -> Graph:
    """Skip edges join each word to the one before it that has the same digits, or the same text
    if it has none, so a word repeated m times gives m - 1 edges."""
    rows, chain, skip, n = [], [], [], 0
    for text, words in docs:
        last: dict[str, int] = {}
        previous = -1
        for a, b in words:
            hot = np.zeros(WIDTH, np.float32)
            hot[described(text, a, b)] = 1
            rows.append(hot)
            if previous == a - 1:
                chain.append((n - 1, n))
            previous = b
            word = text[a:b]
            key = word if "@" in word else "".join(DIGIT.findall(word))
            if len(key) > 3:
                if key in last and (not chain or chain[-1] != (last[key], n)):
                    skip.append((last[key], n))
                last[key] = n
            n += 1
    pairs = [np.array(e, np.int64).reshape(-1, 2) for e in (chain, skip)]
    return Graph(np.array(rows, np.float32).reshape(-1, WIDTH), *pairs)


def _normal(logs: np.ndarray) -> np.ndarray:
    top = logs.max(axis=1, keepdims=True)
    return logs - top - np.log(np.exp(logs - top).sum(axis=1, keepdims=True))


def marginals(g: Graph, field: Field) -> np.ndarray:
    """Label probabilities of every word once damped loopy message passing stands still."""
    unary = g.features @ field.unary
    if not len(unary):
        return unary
    same = np.eye(LABELS) * field.skip
    a = np.concatenate([g.chain[:, 0], g.skip[:, 0]])
    b = np.concatenate([g.chain[:, 1], g.skip[:, 1]])
    potential = np.concatenate([
        np.broadcast_to(field.chain, (len(g.chain), LABELS, LABELS)),
        np.broadcast_to(same, (len(g.skip), LABELS, LABELS)),
    ])
    forth, back = np.zeros((len(a), LABELS)), np.zeros((len(a), LABELS))

    total = unary.astype(np.float64)
    active, done, limits = np.arange(len(a)), 0, None
    while len(active):
        i, j, p = a[active], b[active], potential[active]
        to_b = _normal(np.logaddexp.reduce((total[i] - back[active])[:, :, None] + p, axis=1))
        to_a = _normal(np.logaddexp.reduce((total[j] - forth[active])[:, None, :] + p, axis=2))
        more_b, more_a = ((1 - DAMPING) * (new - old[active]) for new, old in ((to_b, forth), (to_a, back)))
        forth[active] += more_b
        back[active] += more_a
        np.add.at(total, j, more_b)
        np.add.at(total, i, more_a)
        moved = np.zeros(len(total), bool)
        for change in (more_b, more_a):
            moving = np.abs(change).max(axis=1) > TOLERANCE
            moved[i[moving]] = moved[j[moving]] = True
        active = np.flatnonzero(moved[a] | moved[b])
        done += 1
        if done >= ROUNDS and len(active):
            limits = _part_edges(a, b, len(total)) if limits is None else limits
            active = active[done < ROUNDS * (1 + limits[active])]
    return np.exp(_normal(total))


def _part_edges(a: np.ndarray, b: np.ndarray, words: int) -> np.ndarray:
    """For each edge the number of edges in its connected part of the graph."""
    up = list(range(words))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        up[top(x)] = top(y)
    part = np.array([top(x) for x in a.tolist()])
    return np.bincount(part, minlength=words)[part]


def fit(g: Graph, truth: np.ndarray) -> Field:
    """Maximise the pseudo-likelihood: each word's label given its neighbours' labels."""
    unary, chain, skip = np.zeros((WIDTH, LABELS)), np.zeros((LABELS, LABELS)), 0.0
    if not len(truth):
        unary[:, 0] = 1.0
        return Field(unary, chain, skip)
    hot = np.eye(LABELS)[truth]
    left = np.zeros((len(truth), LABELS))
    right, near = left.copy(), left.copy()
    left[g.chain[:, 1]] = hot[g.chain[:, 0]]
    right[g.chain[:, 0]] = hot[g.chain[:, 1]]
    np.add.at(near, g.skip[:, 0], hot[g.skip[:, 1]])
    np.add.at(near, g.skip[:, 1], hot[g.skip[:, 0]])
    squares = [np.full_like(unary, 1e-8), np.full_like(chain, 1e-8), 1e-8]
    for _ in range(EPOCHS):
        p = np.exp(_normal(g.features @ unary + left @ chain + right @ chain.T + skip * near))
        away = (hot - p) / len(truth)
        steps = [
            g.features.T @ away - PENALTY * unary,
            left.T @ away + away.T @ right - PENALTY * chain,
            float((away * near).sum()) - PENALTY * skip,
        ]
        squares = [s + d * d for s, d in zip(squares, steps, strict=True)]
        unary += RATE * steps[0] / np.sqrt(squares[0])
        chain += RATE * steps[1] / np.sqrt(squares[1])
        skip = max(0.0, skip + RATE * steps[2] / np.sqrt(squares[2]))
    return Field(unary, chain, float(skip))


def labels_of(words: list[tuple[int, int]], spans: list[Span]) -> list[int]:
    """The kind of the span that covers most of a word, if it covers half of it."""
    found = []
    for a, b in words:
        best, kind = 0, 0
        for name, x, y in spans:
            shared = min(b, y) - max(a, x)
            if shared > best and 2 * shared >= b - a:
                best, kind = shared, 1 + KINDS.index(name)
        found.append(kind)
    return found


def train(docs: DataFrame, rows: int = TRAIN_ROWS, words: int = TRAIN_WORDS) -> Field:
    """Fit on the base spans of at most ``rows`` documents (doc_id, text), chosen by a hash of the id.

    In the order of the hash, documents are read as far as they have ``words`` words with a digit or ``@``
    together, whether one holds few or many of them; a document with more by itself is passed over. Of
    repeated ids the least text is read, null ids and texts teach nothing.
    """
    ship_package(docs.sparkSession)
    chosen = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def examples(parts):
        for batch in parts:
            ids = batch.column(0).to_pylist()
            for key, (text, marked) in zip(ids, marked_words(batch.column(1)), strict=True):
                if marked:
                    spans = base_spans(text, marked)
                    g = graph([(text, marked)])
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array([key], pa.int64()),
                        "n": pa.array([len(marked)], pa.int64()),
                        "features": [np.packbits(g.features.astype(np.uint8)).tobytes()],
                        "chain": [g.chain.astype(np.int32).tobytes()],
                        "skip": [g.skip.astype(np.int32).tobytes()],
                        "labels": [bytes(labels_of(marked, spans))],
                    })

    texts = one_text_each(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), chosen, "doc_id")
    made = texts.mapInArrow(examples, "doc_id bigint, n bigint, features binary, chain binary, skip binary, labels binary")
    found = collected(made, "n", words, F.xxhash64("doc_id"), "doc_id").to_pylist()
    feats, chains, skips, truth, n = [], [], [], [], 0
    for row in found:
        m = row["n"]
        feats.append(np.unpackbits(np.frombuffer(row["features"], np.uint8), count=m * WIDTH).reshape(m, WIDTH))
        chains.append(np.frombuffer(row["chain"], np.int32).reshape(-1, 2) + n)
        skips.append(np.frombuffer(row["skip"], np.int32).reshape(-1, 2) + n)
        truth.append(np.frombuffer(row["labels"], np.uint8))
        n += m
    if not n:
        return fit(Graph(np.zeros((0, WIDTH), np.float32), np.zeros((0, 2), int), np.zeros((0, 2), int)), np.zeros(0, int))
    g = Graph(np.concatenate(feats).astype(np.float32), np.concatenate(chains), np.concatenate(skips))
    return fit(g, np.concatenate(truth).astype(np.int64))


def added_spans(text: str, words: list[tuple[int, int]], p: np.ndarray, base: list[Span]) -> list[Span]:
    """Runs of words with one sure label that touch no base span, without punctuation around them."""
    found: list[Span] = []
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    run: list[int] | None = None
    label = p.argmax(axis=1)
    for i, (a, b) in enumerate(words):
        kind = int(label[i])
        if not kind or p[i, kind] < SURE or _touches(a, b, taken, starts):
            run = None
            continue
        while a < b and not (text[a].isalnum() or text[a] in "+("):
            a += 1
        while b > a and not (text[b - 1].isalnum() or text[b - 1] == ")"):
            b -= 1
        if a == b:
            run = None
        elif run is not None and run[0] == kind and words[i - 1][1] + 1 == words[i][0]:
            found[-1] = (KINDS[kind - 1], run[1], b)
        else:
            run = [kind, a]
            found.append((KINDS[kind - 1], a, b))
    return found


def _touches(a: int, b: int, taken: list[tuple[int, int]], starts: list[int]) -> bool:
    from bisect import bisect_left

    # spans of different kinds may overlap, so look back over those that begin before b
    at = bisect_left(starts, b)
    return any(y > a for _, y in taken[max(0, at - 8) : at])


def find(texts: pa.Array, field: Field) -> list[tuple[list[Span], list[Span]]]:
    """Base and added spans of every text."""
    found: list[tuple[list[Span], list[Span]]] = []
    pending: list[tuple[int, str, list, list[Span]]] = []
    held = 0

    def settle() -> None:
        nonlocal held
        p = marginals(graph([(t, w) for _, t, w, _ in pending]), field)
        at = 0
        for i, text, words, base in pending:
            own = p[at : at + len(words)]
            at += len(words)
            found[i] = (base, added_spans(text, words, own, base))
        pending.clear()
        held = 0

    for i, (text, words) in enumerate(marked_words(texts)):
        found.append(([], []))
        if words:
            pending.append((i, text, words, base_spans(text, words)))
            held += len(words) + len(text) // 64
            if held > 20_000:
                settle()
    if pending:
        settle()
    return found


def joined(spans: list[Span]) -> str:
    """``kind:start:end`` by kind as listed, then start."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


OUTPUT = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"


def annotate(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """Add counts and digest of the base spans, all spans, and the number of added ones.

    Spans are in code points, end exclusive. A null text is empty and has none. Columns of the
    new names that are there already are replaced.
    """
    ship_package(docs.sparkSession)
    names = [c.split()[0] for c in OUTPUT.split(", ")]

    @F.arrow_udf(f"struct<{OUTPUT.replace(' bigint', ':bigint').replace(' string', ':string')}>")
    def told(texts: pa.Array) -> pa.Array:
        rows = []
        for base, more in find(texts, field):
            own = {f"n_{k}": sum(s[0] == k for s in base) for k in KINDS}
            digest = hashlib.sha256(joined(base).encode()).hexdigest()
            rows.append(own | {"base_sha256": digest, "spans": joined(base + more), "n_added": len(more)})
        kinds = pa.struct([(n, pa.string() if n in ("base_sha256", "spans") else pa.int64()) for n in names])
        return pa.array(rows, kinds)

    return docs.withColumn("_pii", told(text)).withColumns({n: F.col(f"_pii.{n}") for n in names}).drop("_pii")
