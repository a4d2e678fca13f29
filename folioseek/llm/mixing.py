"""Mixing sources to target weights by hierarchical budgeting.

Documents hang in a tree, by default domain, language, source. A token budget goes from the
root to the leaves in proportion to the weights of siblings. What a node cannot fill (its
tokens times ``max_epochs``) is shared out among its siblings by weight, again and again until
nobody overflows; only when a whole group of siblings is full does the rest go to the siblings
of its parent, and so on up. Filling every group from the top with the capacity of whole
subtrees as limits does just that.

A leaf's budget is whole epochs over its documents plus a token prefix of one more epoch. Each
epoch has its own order, by a hash of seed, epoch and document.

Everything is DataFrame functions. Only counts per node are ranked; the place where the prefix
of a leaf ends is found from sums per hash range, then per range inside the one it falls into, so
no leaf is sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioseek.llm.joins import lookup
from folioseek.plans.sizing import materialize

PATH = ("domain", "lang", "source")
#: Hexadecimal digits of the hash that make a range, in turn: a leaf has 4,096 ranges at most in each.
RANGE_DIGITS = (3, 6)


def word_count(text: Column | str) -> Column:
    """Runs of other than ASCII white space; 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    pieces = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.size(F.filter(pieces, lambda w: w != "")).cast("long")


def allocate(leaves: DataFrame, weights: DataFrame, budget: Column, path: tuple[str, ...], max_epochs: int) -> DataFrame:
    """Add ``budget`` (tokens) to the leaves (path, tokens).

    ``weights``: the path columns and an integer ``weight``; nulls at the end of a path make it
    an inner node. Nodes not named weigh 1; weight 0 or less gets nothing. ``budget`` is an
    aggregate over the leaves; budgets are rounded down, so at most a token per node is lost.
    """
    leaves = leaves.withColumn("_cap", F.col("tokens") * max_epochs)
    level = leaves.agg(F.coalesce(budget, F.lit(0)).cast("long").alias("_budget"), F.coalesce(F.sum("_cap"), F.lit(0)).alias("_all"))
    parent = level.select(F.least("_budget", "_all").alias("_budget"), F.lit(0).alias("_root"))
    for depth in range(1, len(path) + 1):
        above, own = ["_root", *path[: depth - 1]], list(path[:depth])
        here = weights.where(F.col(path[depth - 1]).isNotNull())
        if depth < len(path):
            here = here.where(F.col(path[depth]).isNull())
        here = here.groupBy(*own).agg(F.max("weight").alias("weight"))
        nodes = leaves.groupBy(*own).agg(F.sum("_cap").alias("_cap")).withColumn("_root", F.lit(0))
        nodes = nodes.join(here, own, "left").withColumn("_w", F.greatest(F.coalesce("weight", F.lit(1)).cast("long"), F.lit(0).cast("long")))
        nodes = nodes.withColumn("_cap", F.when(F.col("_w") > 0, F.col("_cap")).otherwise(F.lit(0).cast("long")))
        nodes = nodes.join(parent, above)
        order = Window.partitionBy(*above).orderBy(F.coalesce(F.try_divide(F.col("_cap").cast("double"), F.col("_w").cast("double")), F.lit(0.0)), *own)
        before = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        after = F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))
        nodes = nodes.withColumn("_level", F.coalesce(F.try_divide((F.col("_budget") - before).cast("double"), after.cast("double")), F.lit(0.0)))
        nodes = nodes.withColumn("_full", F.col("_cap") <= F.col("_w") * F.col("_level"))
        # the first node that does not fill sets the level for all after it, which are at least as large
        rank = F.row_number().over(order)
        nodes = nodes.withColumn("_rank", rank).withColumn(
            "_first", F.min(F.when(~F.col("_full"), F.struct("_rank", "_level"))).over(Window.partitionBy(*above))
        )
        share = F.floor(F.col("_w") * F.col("_first._level") + F.lit(1e-6)).cast("long")
        nodes = nodes.withColumn("_budget", F.when(F.col("_first").isNull() | (F.col("_rank") < F.col("_first._rank")), F.col("_cap")).otherwise(F.least("_cap", share)))
        parent = nodes.select("_root", *own, "_budget")
    return leaves.drop("_cap").join(parent.drop("_root").withColumnRenamed("_budget", "budget"), list(path))


def _key(seed: int, epoch: Column, document: Column | str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), document))


def mix(
    docs: DataFrame, weights: DataFrame, budget: Column | None = None, path: tuple[str, ...] = PATH, max_epochs: int = 1, seed: int = 0
) -> DataFrame:
    """The documents (doc_id, text, path) of the mixture: one row per document and epoch.

    Adds ``epoch`` (from 1), ``n_tokens`` (words) and ``take_tokens``: all of them but for the
    document in which its leaf's budget ends. A null in the path counts as ''. A document with
    a null id is ordered by its text; rows with equal ids in a leaf are taken together. Texts
    without words come with whole epochs, and with a prefix they fall into. ``budget`` defaults
    to all tokens.
    """
    budget = F.sum("tokens") if budget is None else budget
    names = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in path}
    docs = docs.withColumns({
        "_leaf": F.to_json(F.struct(*[v.alias(c) for c, v in names.items()])),
        "_doc": F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))),
    })
    sized = materialize(
        docs.select("_leaf", "_doc", *[v.alias(c) for c, v in names.items()], word_count("text").alias("_tokens")), "sized"
    )
    leaves = sized.groupBy("_leaf", *path).agg(F.sum("_tokens").alias("tokens"))
    planned = allocate(leaves, weights, budget, path, max_epochs)
    full = F.coalesce(F.floor(F.try_divide(F.col("budget"), F.col("tokens"))), F.lit(0)).cast("long")
    plan = materialize(
        planned.select("_leaf", full.alias("_full"), (F.col("budget") - full * F.col("tokens")).alias("_rest")), "plan"
    )

    last = plan.where("_rest > 0")
    keyed = lookup(sized.select("_leaf", "_doc", "_tokens"), last, "_leaf", "inner").select(
        "_leaf", "_rest", "_tokens", _key(seed, F.col("_full") + 1, "_doc").alias("_k")
    )
    # the range of hashes in which the prefix ends, first by a few digits, then by more
    ends = last.select("_leaf", F.lit("").alias("_end"), F.lit(0).cast("long").alias("_before"))
    running = Window.partitionBy("_leaf").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    for digits in RANGE_DIGITS:
        sums = (
            lookup(keyed, ends, "_leaf", "inner")
            .where(F.startswith("_k", "_end"))
            .groupBy("_leaf", "_rest", "_before", F.substring("_k", 1, digits).alias("_range"))
            .agg(F.sum("_tokens").alias("_n"))
        )
        ends = materialize(
            sums.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_n").over(running), F.lit(0)))
            .where("_before < _rest and _rest <= _before + _n")
            .select("_leaf", F.col("_range").alias("_end"), "_before"),
            "ends",
        )
    inside = (
        lookup(keyed, ends, "_leaf", "inner")
        .where(F.startswith("_k", "_end"))
        .groupBy("_leaf", "_rest", "_before", "_k")
        .agg(F.sum("_tokens").alias("_n"))
    )
    running = Window.partitionBy("_leaf").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        inside.withColumn("_at", F.col("_before") + F.coalesce(F.sum("_n").over(running), F.lit(0)))
        .where("_at < _rest")
        .groupBy("_leaf")
        .agg(F.max(F.struct("_k", (F.col("_rest") - F.col("_at")).alias("_left"))).alias("_cut"))
    )
    limits = materialize(
        plan.join(cuts, "_leaf", "left").select("_leaf", "_full", "_cut._k", "_cut._left"), "limits"
    )
    added = ("epoch", "n_tokens", "take_tokens")
    chosen = lookup(docs.drop(*added), limits, "_leaf", "inner")
    mine = _key(seed, F.col("_full") + 1, "_doc")
    epochs = F.col("_full") + F.when(mine <= F.col("_k"), 1).otherwise(0)
    chosen = chosen.withColumn("_n", epochs).where("_n > 0")
    chosen = chosen.withColumn("n_tokens", word_count("text"))
    chosen = chosen.withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    cut_here = (F.col("epoch") > F.col("_full")) & (mine == F.col("_k"))
    return chosen.withColumn(
        "take_tokens", F.when(cut_here, F.least("n_tokens", "_left")).otherwise(F.col("n_tokens"))
    ).drop("_leaf", "_doc", "_full", "_k", "_left", "_n")
