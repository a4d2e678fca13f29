"""Benchmark decontamination by winnowing.

Words of documents and benchmark items become hashes, runs of ``GRAM`` words become grams, and
of every ``WINDOW - GRAM + 1`` grams in a row the least is kept. Two texts that share ``WINDOW``
words in a row share all grams in them, so also the least; so documents without a kept gram in
common with an item share no window and are done. For the others, fingerprint hits are extended
to whole windows of words, and the words inside are counted.

Items of fewer words than ``WINDOW`` are one window each; they are found through one gram, or
through one word if they have fewer than ``GRAM``, among all of a document's.

Everything is DataFrame functions. Equal texts are judged once. Windows and grams are compared
by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioseek.llm.joins import BROADCAST_BYTES, lookup
from folioseek.plans.sizing import fits_broadcast, materialize

WINDOW, GRAM = 13, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed pattern: what separates words, after A-Z were lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column | str) -> Column:
    """Words of a text in order; none for null."""
    text = F.col(text) if isinstance(text, str) else text
    pieces = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS)
    return F.filter(pieces, lambda w: w != "")


def hashes(text: Column | str) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def runs(h: Column, width: int) -> Column:
    """Hash of every ``width`` neighbours of the array ``h``; empty if it is shorter."""
    count = F.size(h) - (width - 1)
    whole = F.transform(
        F.slice(h, 1, F.greatest(count, F.lit(0))),
        lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, width)]),
    )
    return whole


def least_grams(g: Column, window: int, gram: int) -> Column:
    """Distinct least grams of every window; empty for a text shorter than a window."""
    many = window - gram + 1
    return F.array_distinct(
        F.transform(
            F.slice(g, 1, F.greatest(F.size(g) - (many - 1), F.lit(0))),
            lambda x, i: F.array_min(F.slice(g, i + 1, many)),
        )
    )


def contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, num: int = 1, den: int = 20
) -> DataFrame:
    """One row per document (doc_id, text) against the items (item_id, text).

    Adds n_words, n_hit (words inside an occurrence of a window of an item), n_items, item_ids
    (sorted as strings) and ``contaminated``: some word is hit, and at least ``num / den`` of
    all. A null text has no words; items without words, or with a null id, do not count.
    """
    keyed = docs.withColumn("_key", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    items = materialize(
        benchmark.where("item_id is not null")
        .select(F.col("item_id").cast("string").alias("item"), hashes("text").alias("h"))
        .where(F.size("h") > 0)
        .distinct(),
        "items",
    )
    lengths = sorted({
        min(r[0], window) for r in items.select(F.least(F.size("h"), F.lit(window))).distinct().collect()
    })
    if not lengths:
        return _finished(keyed, None, num, den)

    hashed = keyed.select("_key", hashes("text").alias("h"))
    grams = hashed.select("_key", "h", runs(F.col("h"), gram).alias("g"))
    kept = [grams.select("_key", F.explode(least_grams(F.col("g"), window, gram)).alias("v"))]
    theirs = [
        items.select(runs(F.col("h"), gram).alias("g")).select(F.explode(least_grams(F.col("g"), window, gram)).alias("v"))
    ]
    searches = [(kept[0], theirs[0])] if window in lengths else []
    if any(gram <= n < window for n in lengths):
        middle = items.where(F.size("h").between(gram, window - 1)).select(F.array_min(runs(F.col("h"), gram)).alias("v"))
        searches.append((grams.select("_key", F.explode(F.array_distinct("g")).alias("v")), middle))
    if any(n < gram for n in lengths):
        few = items.where(F.size("h") < gram).select(F.array_min("h").alias("v"))
        searches.append((hashed.select("_key", F.explode(F.array_distinct("h")).alias("v")), few))
    found = [
        lookup(ours, wanted.distinct(), "v", "left_semi").select("_key")
        for ours, wanted in searches
    ]
    suspects = found[0]
    for more in found[1:]:
        suspects = suspects.union(more)
    suspects = materialize(suspects.distinct(), "suspects")

    texts = lookup(keyed.select("_key", "text"), suspects, "_key", "left_semi").dropDuplicates(["_key"])
    texts = materialize(texts.select("_key", hashes("text").alias("h")), "suspect_words")
    # windows that the same items have are of one class, so a place carries a number and not the items
    windows = None
    for n in lengths:
        own = items.where(F.size("h") >= n) if n == window else items.where(F.size("h") == n)
        made = own.select("item", F.explode(F.array_distinct(runs(F.col("h"), n))).alias("w"), F.lit(n).alias("n"))
        windows = made if windows is None else windows.union(made)
    windows = materialize(windows.distinct(), "windows")
    of_items = F.xxhash64(F.bit_xor(F.xxhash64("item")), F.count(F.lit(1)), F.min("item"), F.max("item"))
    classes = materialize(windows.groupBy("n", "w").agg(of_items.alias("class")), "window_classes")
    first = classes.groupBy("class").agg(F.min(F.struct("n", "w")).alias("one")).select("class", "one.n", "one.w")
    members = materialize(windows.join(first, ["n", "w"]).select("class", "item"), "class_items")

    hits = None
    for n in lengths:
        places = texts.select("_key", F.posexplode(runs(F.col("h"), n)).alias("at", "w"))
        hit = lookup(places, classes.where(F.col("n") == n).select("w", "class"), "w", "inner").select(
            "_key", F.struct("at", F.lit(n).alias("n")).alias("span"), "class"
        )
        hits = hit if hits is None else hits.union(hit)
    spans = materialize(hits.groupBy("_key").agg(F.collect_set("span").alias("spans"), F.collect_set("class").alias("classes")), "spans")
    held = spans.select("_key", F.explode("classes").alias("class")).join(_small(members), "class").select("_key", "item").distinct()
    named = held.groupBy("_key").agg(F.sort_array(F.collect_list("item")).alias("item_ids"))
    # spans in order of their begin; each adds what reaches beyond the ones before it
    covered = F.aggregate(
        F.sort_array("spans"),
        F.struct(F.lit(0).alias("hit"), F.lit(0).alias("upto")),
        lambda a, s: F.struct(
            (a["hit"] + F.greatest(F.lit(0), s["at"] + s["n"] - F.greatest(a["upto"], s["at"]))).alias("hit"),
            F.greatest(a["upto"], s["at"] + s["n"]).alias("upto"),
        ),
    )
    judged = materialize(spans.select("_key", covered["hit"].cast("long").alias("n_hit")).join(named, "_key"), "hits")
    return _finished(keyed, judged, num, den)


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if fits_broadcast(table, BROADCAST_BYTES, measure=True) else table


def _finished(keyed: DataFrame, judged: DataFrame | None, num: int, den: int) -> DataFrame:
    names = ["n_words", "n_hit", "n_items", "item_ids", "contaminated"]
    docs = keyed.drop(*names).withColumn("n_words", F.size(words("text")).cast("long"))
    if judged is None:
        docs = docs.withColumns({"n_hit": F.lit(0).cast("long"), "item_ids": F.array().cast("array<string>")})
    else:
        judged = judged.withColumnRenamed("n_hit", "_n").withColumnRenamed("item_ids", "_items")
        docs = lookup(docs, judged, "_key", "left").withColumns({
            "n_hit": F.coalesce("_n", F.lit(0).cast("long")),
            "item_ids": F.coalesce("_items", F.array().cast("array<string>")),
        }).drop("_n", "_items")
    return docs.drop("_key").withColumns({
        "n_items": F.size("item_ids").cast("long"),
        "contaminated": (F.col("n_hit") > 0) & (F.col("n_hit") * den >= F.col("n_words") * num),
    })
