"""Near copies among vectors by Euclidean p-stable hashing.

Vectors of one label are normalised, so their distance decides their cosine. A hash projects a
vector on a Gaussian direction, shifts it by a random offset and cuts the line into bins of
``BIN``: near vectors fall into one bin more often than far ones. ``HASHES`` bins together are a
vector's bucket in a table, of which there are ``TABLES``. Vectors that share a bucket are
compared by their exact cosine, all of them and in no other place.

Projections must come out alike in every task. Unit vectors and directions are rounded to whole
numbers whose products and sums stay below 2^53, so doubles hold them exactly in any order of
addition; rounding moves a projection by about a millionth of a bin.

Equal vectors of a label are one class from the beginning. The members of a bucket meet in cells
of at most two blocks of ``BLOCK``, so a hot bucket becomes many tasks; a cell counts the links of its
members and gives back a spanning forest of them, never the pairs. A pair that shares buckets in
several tables is counted in the first of them only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioseek.llm import batches
from folioseek.llm.components import components
from folioseek.plans.shipping import ship_package
from folioseek.plans.sizing import materialize

#: Width of a bin, hashes of a bucket, tables. Two vectors with cosine 0.98 are 0.2 apart and share a
#: bin with probability 0.92, a bucket in some table with 0.99; perpendicular ones share a bucket
#: in a table with 5e-7.
BIN, HASHES, TABLES = 2.0, 20, 22
#: Bits after the point of whole-number coordinates and directions: 20 + 12 + 3 (largest direction) + 18 (dimensions) = 53.
COORDINATE_BITS, DIRECTION_BITS = 20, 12
#: Members of a block; cells of fewer members are compared together, vectorised over their pairs.
BLOCK, SMALL = 1024, 48
#: Cosines this near to the threshold are added up again in the order of the coordinates.
DOUBT = 1e-12
SEED = 97


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows divided by their lengths, which are taken after scaling so that they neither overflow nor vanish."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


@lru_cache(4)
def directions(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole-number directions of all hashes, and their offsets in the same unit."""
    rng = np.random.default_rng([SEED, dim])
    lines = np.rint(rng.standard_normal((dim, TABLES * HASHES)) * 2**DIRECTION_BITS)
    shifts = np.floor(rng.random(TABLES * HASHES) * BIN * 2.0 ** (COORDINATE_BITS + DIRECTION_BITS))
    return lines, shifts


def buckets(units: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Bucket of each unit vector in each table, as 64-bit hashes that hold table, dimension and label."""
    lines, shifts = directions(units.shape[1])
    projected = np.rint(units * 2**COORDINATE_BITS) @ lines + shifts
    bins = np.floor(projected / (BIN * 2.0 ** (COORDINATE_BITS + DIRECTION_BITS))).astype(np.int64).view(np.uint64)
    bins = bins.reshape(len(units), TABLES, HASHES)
    h = batches.mixed(labels.astype(np.int64).view(np.uint64)[:, None] * np.uint64(batches.BASE) + np.arange(TABLES, dtype=np.uint64))
    h = batches.mixed(h + np.uint64(units.shape[1]))
    for i in range(HASHES):
        h = batches.mixed(h * np.uint64(batches.BASE) + bins[:, :, i])
    return h


def usable(column: pa.Array) -> tuple[list[np.ndarray | None], np.ndarray]:
    """Each vector in double, or none where it is null, empty, zero or holds a null or a non-finite number."""
    found: list[np.ndarray | None] = []
    offsets = column.offsets.to_numpy()
    values = column.values.cast(pa.float64())
    bad = np.asarray(values.is_null())
    flat = values.fill_null(0.0).to_numpy(zero_copy_only=False)
    wrong = np.concatenate([[0], np.cumsum(bad | ~np.isfinite(flat))])
    some = np.concatenate([[0], np.cumsum(flat != 0)])
    there = np.asarray(column.is_valid())
    a, b = offsets[:-1], offsets[1:]
    ok = there & (wrong[b] == wrong[a]) & (some[b] > some[a])
    for i, low, high in zip(ok.tolist(), a.tolist(), b.tolist(), strict=True):
        found.append(flat[low:high] if i else None)
    return found, ok


def _described(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``vec_id, label, vector`` (bytes of doubles; null where it links with nothing), numbered."""
    row = TaskContext.get().partitionId() << 40
    for batch in parts:
        ids, labels = batch.column(0), batch.column(1)
        there = np.asarray(ids.is_valid()) & np.asarray(labels.is_valid())
        for low in range(0, batch.num_rows, 2048):
            vectors, _ = usable(batch.column(2).slice(low, 2048))
            raw = [v.tobytes() if v is not None and t else None for v, t in zip(vectors, there[low : low + 2048].tolist(), strict=True)]
            n = len(raw)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + n)), ids.slice(low, n), labels.slice(low, n), pa.array(raw, pa.binary())],
                ["row", "vec_id", "label", "v"],
            )
            row += n


def _by_width(raw: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of equally long vectors, and those vectors as rows."""
    width = np.array([len(v) for v in raw])
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        yield at, np.frombuffer(b"".join(raw[i] for i in at.tolist())).reshape(len(at), -1)


def _hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        for low in range(0, batch.num_rows, 2048):
            cut = batch.slice(low, 2048)
            ids, labels = cut.column(0).to_numpy(), cut.column(1).to_numpy()
            for at, vectors in _by_width(cut.column(2).to_pylist()):
                h = buckets(unit(vectors), labels[at])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.ravel().view(np.int64)), pa.array(np.repeat(ids[at], TABLES))], ["bucket", "cid"]
                )


class Cells:
    """Members of one or several cells, sorted by cell: which pairs of them link, in which table first."""

    def __init__(self, bucket, ids, labels, vectors: np.ndarray, least: float):
        self.bucket, self.ids, self.least, self.labels = bucket.view(np.uint64), ids, least, labels
        self.plain, self.units = vectors, unit(vectors)
        self.buckets = buckets(self.units, labels)

    def linked(self, i: np.ndarray, j: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        """Whether pairs of places link, given their cosines up to rounding."""
        doubt = np.flatnonzero(np.abs(cosine - self.least) < DOUBT)
        for k in doubt.tolist():
            a, b = self.units[i[k]], self.units[j[k]]
            cosine[k] = (a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum())
        return (cosine >= self.least) & (self.labels[i] == self.labels[j]) & (self.ids[i] != self.ids[j])

    def first(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the cell's bucket is the first that the two members of a pair share."""
        table = np.argmax(self.buckets[i] == self.buckets[j], axis=1)
        return self.buckets[i, table] == self.bucket[i]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least place within reach of each place over the pairs, each given once."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compared(least: float):
    """Of each cell the links of each member (``n`` copies counted) and an edge to another member within reach."""

    def of_cells(bucket, block_a, block_b, block, ids, labels, copies, raw) -> Iterator[tuple[np.ndarray, ...]]:
        for at, vectors in _by_width(raw):
            cells = Cells(bucket[at], ids[at], labels[at], vectors, least)
            new = (np.diff(bucket[at]) != 0) | (np.diff(block_a[at]) != 0) | (np.diff(block_b[at]) != 0)
            cuts = np.concatenate([[0], np.flatnonzero(new) + 1, [len(at)]])
            size, own = np.diff(cuts), block[at]
            crossed = (block_a[at] != block_b[at])[cuts[:-1]]
            pairs_i, pairs_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            if len(at):
                after = np.repeat(cuts[1:], size) - np.arange(len(at)) - 1
                after[np.repeat((size > SMALL) | crossed, size)] = 0
                i = np.repeat(np.arange(len(at)), after)
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)
                for low in range(0, len(i), 1 << 17):
                    a, b = i[low : low + (1 << 17)], j[low : low + (1 << 17)]
                    ok = cells.linked(a, b, (cells.units[a] * cells.units[b]).sum(axis=1))
                    pairs_i.append(a[ok])
                    pairs_j.append(b[ok])
            yield _sums(cells, copies[at], np.concatenate(pairs_i), np.concatenate(pairs_j))
            for c in np.flatnonzero((size > SMALL) | crossed).tolist():
                x = y = np.arange(cuts[c], cuts[c + 1])
                if crossed[c]:
                    first = own[cuts[c] : cuts[c + 1]] == block_a[at][cuts[c]]
                    x, y = x[first], x[~first]
                if not len(x) or not len(y):
                    continue  # pairs inside one block belong to its own cell
                cosine = cells.units[x] @ cells.units[y].T
                if not crossed[c]:
                    cosine[np.tril_indices(len(x))] = -2
                i, j = np.nonzero(cosine >= least - DOUBT)
                ok = cells.linked(x[i], y[j], cosine[i, j])
                yield _sums(cells, copies[at], x[i[ok]], y[j[ok]])

    def _sums(cells: Cells, copies, i, j):
        n = np.zeros(len(copies), np.int64)
        for low in range(0, len(i), 1 << 17):
            a, b = i[low : low + (1 << 17)], j[low : low + (1 << 17)]
            once = cells.first(a, b)
            n += np.bincount(a[once], copies[b[once]], len(n)).astype(np.int64)
            n += np.bincount(b[once], copies[a[once]], len(n)).astype(np.int64)
        used = np.unique(np.concatenate([i, j]))
        place = np.zeros(len(n), np.int64)
        place[used] = np.arange(len(used))
        top = used[_forest(len(used), place[i], place[j])] if len(used) else used
        return cells.ids[used], n[used], cells.ids[top]

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            columns = [table.column(i).to_numpy() for i in range(7)]
            for ids, n, top in of_cells(*columns, table.column(7).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array(top)], ["cid", "n", "top"])

        for batch in parts:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            last = np.ones(len(held), bool)
            for i in range(3):
                mark = held.column(i).to_numpy()
                last &= mark == mark[-1]
            whole = int(np.argmax(last))  # the last cell may go on in the next batch
            if whole:
                yield from out(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and len(held):
            yield from out(held)

    return rows


def near_copies(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """One row per vector (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Two vectors of one label and length link when their cosine is at least ``least`` and they
    share a bucket. ``component_id`` is the least vec_id that links lead to, its own included;
    ``kept`` says whether it is the row's own. A null, empty or zero vector, one that holds a null or a
    non-finite number, and rows with a null label link with nothing, nor do rows with a null id, whose
    component is null and which are kept. Rows repeated with their id link with each other; rows with one id
    and different vectors are separate rows. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    shape = "row bigint, vec_id bigint, label bigint, v binary"
    rows = materialize(
        vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding").mapInArrow(_described, shape), "vectors"
    )
    fit = rows.where("v is not null")
    # copies are told apart from others by two 64-bit hashes
    key = [F.xxhash64("label", "v").alias("h1"), F.xxhash64("v", F.lit(SEED), "label").alias("h2")]
    counted = (
        fit.select(*key, "row", "vec_id").groupBy("h1", "h2")
        .agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    )
    classes = materialize(counted.select("h1", "h2", F.col("row").alias("cid"), "copies", "least"), "classes")
    chosen = fit.join(classes.select(F.col("cid").alias("row"), "copies"), "row").select(F.col("row").alias("cid"), "label", "v", "copies")

    places = materialize(chosen.select("cid", "label", "v").mapInArrow(_hashed, "bucket bigint, cid bigint"), "buckets")
    shared = materialize(places.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "shared")
    of_class = places.join(shared, "bucket").groupBy("cid").agg(F.collect_list(F.struct("bucket", "m")).alias("places"))
    cells = (
        of_class.join(chosen, "cid")
        .select("cid", "label", "v", "copies", F.explode("places").alias("p"))
        .select("cid", "label", "v", "copies", "p.bucket", F.ceil(F.col("p.m") / BLOCK).cast("long").alias("blocks"))
        .withColumn("block", F.pmod(F.xxhash64("cid"), "blocks"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select(
            "bucket", F.least("block", "other").alias("block_a"), F.greatest("block", "other").alias("block_b"),
            "block", "cid", "label", "copies", "v",
        )
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = cells.repartition(n, "bucket", "block_a", "block_b").sortWithinPartitions("bucket", "block_a", "block_b")
    found = materialize(ordered.mapInArrow(_compared(least), "cid bigint, n bigint, top bigint"), "links")

    degrees = found.groupBy("cid").agg(F.sum("n").alias("n"))
    labels = components(found.where("cid <> top").select(F.col("cid").alias("a"), F.col("top").alias("b")).distinct())
    placed = (
        classes.join(degrees, "cid", "left").join(labels.withColumnRenamed("node", "cid"), "cid", "left")
        .withColumn("component", F.coalesce("component", "cid"))
    )
    least_id = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.join(least_id, "component").select(
        "h1", "h2", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"
    )
    together = rows.select("vec_id", *[F.when(F.col("v").isNotNull(), k).alias(a) for k, a in zip(key, ("h1", "h2"), strict=True)])
    component = F.coalesce("component_id", "vec_id")
    return together.join(named, ["h1", "h2"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
