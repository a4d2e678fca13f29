"""Plain Python versions of the operators, and rows that are awkward for them."""

from __future__ import annotations

import re

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile("[^\x20\x09-\x0d]+")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

LONG = " ".join(f"w{i % 997}" for i in range(30_000))
#: doc_id, text: nulls, empty and blank texts, very long ones, ties, repeated rows, odd white space.
ODD = [
    (None, "a text without an id"),
    (None, None),
    (1, None),
    (2, ""),
    (3, "  \t\n "),
    (4, LONG),
    (5, LONG + " end"),
    (6, "one two three"),
    (7, "one two three"),
    (8, "The quick brown fox jumps over the lazy dog and runs far away from home today"),
    (8, "The quick brown fox jumps over the lazy dog and runs far away from home today"),
    (9, "THE QUICK brown fox jumps over the lazy dog and runs far away from home today"),
    (10, "x" * 50_000),
    (11, "é ü 漢字　“quoted”  twice"),
    (12, "12345 !!! ???"),
    (2**40, "mail a.b@c.de, +49 (30) 1234567, 10.0.0.1 and 4111 1111 1111 1111."),
]


def frame(spark, rows, extra: str = ""):
    """A table doc_id, text, lang, source, n_chars, with columns whose names operators use."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, _row string, n_words string"
    full = [
        (i, t, None if k % 5 == 4 else ("en", "de")[k % 2], None if k % 7 == 6 else f"src{k % 3}", len(t or ""), "s", "r", "n")
        for k, (i, t) in enumerate(rows)
    ]
    return spark.createDataFrame(full, schema)


def words(text):
    return SPACED.findall((text or "").translate(UPPER))


def shingles(text, width):
    w = words(text)
    if len(w) >= width:
        return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def components(rows, width, num, den):
    """For each place in rows the least id reachable, by comparing all pairs."""
    sets = [shingles(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            shared = len(sets[i] & sets[j])
            if den * shared >= num * (len(sets[i]) + len(sets[j]) - shared):
                up[top(i)] = top(j)
    least: dict = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[top(i)] = min(key, least.get(top(i), key))
    return [None if key is None else least[top(i)] for i, (key, _) in enumerate(rows)]
