from __future__ import annotations

import random

import brute
import pytest

from folioseek.llm import decontaminate

ITEMS = "item_id bigint, text string, doc_id string"


def words(text):
    return brute.WORD.findall((text or "").translate(brute.UPPER))


def plain(rows, items, window=13):
    windows = {}
    for item, text in items:
        w = words(text)
        if w and item is not None:
            n = min(len(w), window)
            for i in range(len(w) - n + 1):
                windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    found = []
    for key, text in rows:
        w = words(text)
        hit, own = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    own |= windows[tuple(w[i : i + n])]
        found.append((key, len(w), len(hit), sorted(own), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return found


def same(spark, rows, items, **options):
    docs = brute.frame(spark, rows)
    found = decontaminate.contaminated(docs, spark.createDataFrame([(*i, "x") for i in items], ITEMS), **options)
    assert set(docs.columns) <= set(found.columns)
    got = [(r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in found.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain(rows, items, options.get("window", 13))))
    return got


@pytest.mark.parametrize("seed", range(3))
def test_equals_all_windows(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(25)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 5, 9, 12, 13, 14, 30])))) for i in range(12)]
    rows = []
    for i in range(60):
        own = [rng.choice(vocabulary) + "q" for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            taken = rng.choice(items)[1].split()
            cut = rng.randrange(len(taken))
            at = rng.randrange(len(own) + 1)
            own[at:at] = taken[cut:] + taken[:cut] if rng.random() < 0.5 else taken
        rows.append((i, ("! " if seed else " ").join(own).title()))
    got = same(spark, rows, items)
    assert any(r[4] for r in got) and not all(r[4] for r in got)


def test_odd_rows(spark):
    items = [
        (1, brute.ODD[9][1]), (2, brute.ODD[9][1]), (None, "one two three"), (3, None), (4, "!!"), (5, "three"),
        (6, "漢字 quoted"), (7, brute.LONG[:2000]),
    ]
    same(spark, brute.ODD, items)
    same(spark, brute.ODD, items, window=7, gram=3)


def test_empty_tables(spark):
    same(spark, brute.ODD, [])
    same(spark, [], [(1, "a b c")])


def test_long_spans_share_a_least_gram(spark):
    rows = [(1, " ".join(f"a{i}" for i in range(40))), (2, " ".join(f"a{i}" for i in range(14, 27)))]
    got = same(spark, rows, [(1, " ".join(f"a{i}" for i in range(14, 27)))])
    assert [r[2] for r in sorted(got)] == [13, 13]
