"""N-gram Jaccard join with count-vector trees.

The shingles of a document are hashed into groups; the counts of the groups are a point. Two
sets cannot share more shingles than the summed minima of their points, which bounds the
overlap of a pair, and, with the largest counts below a node, of all pairs under two nodes of a
tree. Pairs that survive are verified on the whole shingle sets.

A tree over all documents would not prune: with random texts of like size every node covers
nearly the whole range of every count. So a tree is built per rare shingle. Under one order of
all shingles, frequent ones last, two linked sets share one among their first
``n - ceil(t n) + 1`` shingles (a prefix); documents that share a prefix shingle form a bucket.

Work on a bucket avoids its pairs. First every member is paired with a few of them, the least
and greatest by some hashes of their keys, which links most near copies; components of the verified links follow. Only members in
different components are then joined, by trees; very large buckets in blocks. Equal sets are
one member from the beginning, so copies cost nothing. No link is lost: a link joins members
of one component, or its pair meets in some bucket's trees. The number of links is counted
last: all links lie inside components, whose members meet in cells, where trees prune their
pairs and whole sets verify them; only counts leave a cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioseek.llm import batches
from folioseek.llm.bits import bit_map, hits
from folioseek.llm.components import components, merged
from folioseek.llm.joins import lookup
from folioseek.plans.shipping import ship_package
from folioseek.plans.sizing import materialize, release

#: Groups of the points in a tree, and most groups of the points that its survivors are checked by.
COARSE, WIDEST = 16, 256
#: A shingle counts as frequent from so many documents on; at most so many frequent ones are
#: sent to the tasks. These only move work between buckets: results do not depend on them.
FREQUENT, FREQUENT_KEPT = 32, 1 << 19
#: Shingles that a task counts at a time.
COUNTED_TOGETHER = 1 << 21
LEAF, FANOUT, BLOCK = 16, 8, 2048
#: Most pairs of nodes that a task tests at a time, as children of pairs that reached the threshold.
EXPANDED = 1 << 16
#: Pairs of fine points that a task compares at a time.
FINE_TOGETHER = 1 << 12
#: Members of a bucket, besides the least and the greatest, that all others are paired with.
CENTERS = 2
#: Logarithm of the number of 64-bit slots of the bit map of shared shingles. It only keeps others from being shuffled.
MARK_BITS = 19
#: Members, and shingles of all members together, of a block of a component whose links are counted.
COUNTED_SETS, COUNTED_SHINGLES = 512, 1 << 20


def signature(shingles: np.ndarray) -> int:
    """One 64-bit key of a set, as a signed number."""
    total = batches.mixed(shingles.sum(keepdims=True, dtype=np.uint64) + np.uint64(len(shingles)))
    other = np.bitwise_xor.reduce(batches.mixed(shingles + np.uint64(batches.MIX)))
    return int(batches.mixed(total ^ other).view(np.int64)[0])


def fine_groups(n: int) -> int:
    """Groups of the fine point of a set of ``n``: a power of two, 4 to 8 shingles each."""
    return max(COARSE, 1 << max(0, (n // 4).bit_length() - 1))


def point(shingles: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount((shingles & np.uint64(groups - 1)).astype(np.int64), minlength=groups)


def bucket_point(shingles: np.ndarray) -> bytes:
    """The point that goes into buckets: about a group per shingle, ``WIDEST`` at most.

    One byte per count, or two or four if a count needs them; the first two bytes tell which.
    """
    return stored_point(point(shingles, min(WIDEST, max(COARSE, 1 << (len(shingles) - 1).bit_length()))))


def stored_point(counts: np.ndarray) -> bytes:
    kind = next(k for k in ("u1", "<u2", "<u4") if counts.max() < 1 << 8 * np.dtype(k).itemsize)
    return bytes([len(counts).bit_length() - 1, np.dtype(kind).itemsize]) + counts.astype(kind).tobytes()


def read_point(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[1]}", offset=2).astype(np.int64)


class FinePoints:
    """Points of a cell, read and folded when they are first asked for."""

    def __init__(self, raw: list[bytes]):
        self.raw, self.width = raw, np.array([1 << r[0] for r in raw])
        self.read: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of(self, groups: int, places: np.ndarray) -> np.ndarray:
        """Points of all members in so many groups, of which those at ``places`` are filled in."""
        if groups not in self.read:
            self.read[groups] = np.zeros((len(self.raw), groups), np.int32), np.zeros(len(self.raw), bool)
        points, there = self.read[groups]
        wanted = np.zeros(len(there), bool)
        wanted[places] = True
        for i in np.flatnonzero(wanted & ~there).tolist():
            points[i] = folded(read_point(self.raw[i]), groups)
        there |= wanted
        return points


def fine_survivors(pairs: np.ndarray, fine: FinePoints, sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Those pairs of places whose points, as fine as both have them, still reach the threshold."""
    kept = np.zeros(len(pairs), bool)
    groups = np.minimum(fine.width[pairs[:, 0]], fine.width[pairs[:, 1]])
    for g in np.unique(groups).tolist():
        at = np.flatnonzero(groups == g)
        points = fine.of(g, pairs[at].ravel())
        for low in range(0, len(at), FINE_TOGETHER):
            some = at[low : low + FINE_TOGETHER]
            i, j = pairs[some, 0], pairs[some, 1]
            shared = np.minimum(points[i], points[j]).sum(axis=1)
            kept[some] = shared * (num + den) >= num * (sizes[i] + sizes[j])
    return pairs[kept]


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """A fine point as a coarser one: groups are low bits of the hash, so they nest."""
    return counts.reshape(-1, groups).sum(axis=0)


class CountTree:
    """Points packed into nodes of near points, with the largest count of each group per node."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = self._packed(points, sizes)
        points, sizes = points[self.order], sizes[self.order]
        self.levels = [(points, sizes, sizes)]
        step = LEAF
        while True:
            top, least, most = self.levels[-1]
            at = np.arange(0, len(top), step)
            self.levels.append((
                np.maximum.reduceat(top, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)
            ))
            if len(at) == 1:
                break
            step = FANOUT

    @staticmethod
    def _packed(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Order by size, then in slabs by the two most spread groups."""
        order = np.argsort(sizes, kind="stable")
        wide = np.argsort(-points.std(axis=0))[:2]
        for axis in wide:
            slab = max(LEAF, int(len(order) ** (2 / 3 if axis == wide[0] else 1 / 3)))
            order = np.concatenate([
                part[np.argsort(points[part, axis], kind="stable")]
                for part in (order[i : i + slab] for i in range(0, len(order), slab))
            ])
        return order


def surviving(a: CountTree, b: CountTree | None, num: int, den: int) -> np.ndarray:
    """Places ``(i, j)`` of point pairs whose bound reaches the threshold ``num / den``.

    With ``b`` left out, pairs inside ``a``, each once.
    """
    return np.concatenate([np.zeros((0, 2), np.int64), *surviving_pieces(a, b, num, den)])


def surviving_pieces(a: CountTree, b: CountTree | None, num: int, den: int) -> Iterator[np.ndarray]:
    """``surviving`` in pieces of ``EXPANDED`` pairs at most: branches are gone down one after another."""
    own = b is None
    b = a if own else b

    def reaching(p: np.ndarray, la: int, lb: int) -> np.ndarray:
        (ta, na, xa), (tb, nb, xb) = a.levels[la], b.levels[lb]
        i, j = p[:, 0], p[:, 1]
        most = np.minimum(np.minimum(ta[i], tb[j]).sum(axis=1), np.minimum(xa[i], xb[j]))
        return p[most * (num + den) >= num * (na[i] + nb[j])]

    la, lb = len(a.levels) - 1, len(b.levels) - 1
    open_ = [(reaching(np.zeros((1, 2), np.int64), la, lb), la, lb)]
    while open_:
        pairs, la, lb = open_.pop()
        if la or lb:
            some, rest = pairs[: EXPANDED // LEAF**2], pairs[EXPANDED // LEAF**2 :]
            if len(rest):
                open_.append((rest, la, lb))
            if len(some):  # the deeper tree goes down, or both
                below, la, lb = _children(some, a, b, la, lb, own)
                open_.append((reaching(below, la, lb), la, lb))
            continue
        if own:
            pairs = pairs[pairs[:, 0] < pairs[:, 1]]
        if len(pairs):
            yield np.stack([a.order[pairs[:, 0]], b.order[pairs[:, 1]]], axis=1)


def _children(pairs, a: CountTree, b: CountTree, la: int, lb: int, own: bool):
    def below(nodes, tree, level):
        step = LEAF if level == 1 else FANOUT
        return nodes[:, None] * step + np.arange(step), len(tree.levels[level - 1][0])

    down_a, down_b = la >= lb, lb >= la
    i, j = pairs[:, 0][:, None], pairs[:, 1][:, None]
    if down_a:
        i, limit_a = below(pairs[:, 0], a, la)
    if down_b:
        j, limit_b = below(pairs[:, 1], b, lb)
    shape = (len(pairs), i.shape[1], j.shape[1])
    i, j = np.broadcast_to(i[:, :, None], shape).ravel(), np.broadcast_to(j[:, None, :], shape).ravel()
    ok = np.ones(len(i), bool)
    if down_a:
        ok &= i < limit_a
    if down_b:
        ok &= j < limit_b
    if own:
        ok &= i <= j
    return np.stack([i[ok], j[ok]], axis=1), la - down_a, lb - down_b


def _sets(column: pa.Array, width: int):
    for low, _, data, offsets in batches.chunks(column):
        for i, own in enumerate(batches.shingle_sets(data, offsets, width)):
            yield low + i, own


def _frequent(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles and their counts, as far as repeats inside a task show them."""

    def repeated(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        held = 0

        def flush() -> pa.RecordBatch:
            shingle, n = np.unique(np.concatenate(list(seen.values())), return_counts=True)
            twice = n > 1
            return pa.RecordBatch.from_arrays(
                [pa.array(shingle[twice].view(np.int64)), pa.array(n[twice].astype(np.int64))], ["shingle", "n"]
            )

        for batch in parts:
            for _, own in _sets(batch.column(0), width):
                if len(own):
                    seen[signature(own)] = own
                    held += len(own)
                if held > COUNTED_TOGETHER:
                    yield flush()
                    seen, held = {}, 0
        if seen:
            yield flush()

    counted = materialize(
        docs.select("text").mapInArrow(repeated, "shingle bigint, n bigint")
        .groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT),
        "frequent",
    )
    histogram = counted.groupBy("n").agg(F.count(F.lit(1)).alias("m")).toArrow()
    n, m = (histogram.column(i).to_numpy() for i in range(2))
    order = np.argsort(-n)
    fitting = n[order][np.cumsum(m[order]) <= FREQUENT_KEPT]
    if not len(fitting):
        release(counted)
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = counted.where(F.col("n") >= int(fitting[-1])).toArrow()
    release(counted)
    keys, counts = rows.column(0).to_numpy().view(np.uint64), rows.column(1).to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


def describe(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """One row per document: doc_id, hash of its text, n (shingles), key of its set, bucket point, prefix."""
    frequent, counts = _frequent(docs, width)
    sent = docs.sparkSession.sparkContext.broadcast((frequent, counts))

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = sent.value
        for batch in parts:
            ids = batch.column(0)
            keys, sizes, points, prefixes, done = [], [], [], [], 0

            def flush(high: int) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [
                        ids.slice(done, high - done), batch.column(2).slice(done, high - done),
                        pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()),
                        pa.array(points, pa.binary()),
                        pa.ListArray.from_arrays(
                            pa.array(np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]), pa.int32()),
                            pa.array(np.concatenate(prefixes).view(np.int64)),
                        ),
                    ],
                    ["doc_id", "text_hash", "n", "key", "point", "prefix"],
                )

            for i, own in _sets(batch.column(1), width):
                n = len(own)
                keys.append(signature(own) if n else None)
                sizes.append(n)
                points.append(bucket_point(own) if n else None)
                rank = np.zeros(n, np.int64)
                if len(frequent) and n:
                    at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
                    rank = np.where(frequent[at] == own, counts[at], 0)
                length = n - -(-num * n // den) + 1 if n else 0
                prefixes.append(own[np.argsort(rank, kind="stable")[:length]])
                if len(keys) == 4096:
                    yield flush(i + 1)
                    keys, sizes, points, prefixes, done = [], [], [], [], i + 1
            if keys:
                yield flush(batch.num_rows)

    described = materialize(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text")).mapInArrow(
            rows, "doc_id bigint, text_hash bigint, n bigint, key bigint, point binary, prefix array<bigint>"
        ),
        "described",
    )
    sent.destroy()
    return described


def _pair(a: Column | str, b: Column | str) -> list[Column]:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def verify(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The linked ones among candidate pairs of set keys (``a``, ``b``), as a stored table.

    ``classes``: key, n, doc_id of one document. Sizes are compared first, then the fine points,
    then the sets; points and sets are made again from the texts of the documents they need.
    """

    def sized(df: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            df = df.join(classes.select(F.col("key").alias(side), F.col("n").alias(f"n{side}")), side)
        return df.where(f"least(na, nb) * {den} >= greatest(na, nb) * {num}").select("a", "b")

    left = materialize(sized(pairs.distinct()), "pairs")

    def of_documents(pairs: DataFrame, what, name: str) -> DataFrame:
        keys = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
        wanted = keys.join(classes, "key").select("doc_id").distinct()
        texts = lookup(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), wanted, "doc_id", "left_semi")

        def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in parts:
                keys, values = [], []
                for _, own in _sets(batch.column(0), width):
                    if len(own):
                        keys.append(signature(own))
                        values.append(what(own))
                    if len(keys) == 1024:
                        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.binary())], ["key", "v"])
                        keys, values = [], []
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.binary())], ["key", "v"])

        return materialize(texts.select("text").mapInArrow(rows, "key bigint, v binary"), name)

    def both(pairs: DataFrame, values: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            # the texts of one id may differ, so values are looked up by the key of their set
            pairs = pairs.join(values.select(F.col("key").alias(side), F.col("v").alias(f"v{side}")), side)
        return pairs.select("a", "b", "va", "vb")

    def fine(own: np.ndarray) -> bytes:
        return len(own).to_bytes(8, "little") + stored_point(point(own, fine_groups(len(own))))

    def enough(shared: int, na: int, nb: int) -> bool:
        return shared * (num + den) >= num * (na + nb)

    def may_link(x: bytes, y: bytes) -> bool:
        na, nb = int.from_bytes(x[:8], "little"), int.from_bytes(y[:8], "little")
        p, q = read_point(x[8:]), read_point(y[8:])
        groups = min(len(p), len(q))
        return enough(int(np.minimum(folded(p, groups), folded(q, groups)).sum()), na, nb)

    def link(x: bytes, y: bytes) -> bool:
        p, q = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
        return enough(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q))

    def passed(test):
        def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in parts:
                x, y = batch.column(2), batch.column(3)
                ok = [test(x[i].as_py(), y[i].as_py()) for i in range(batch.num_rows)]
                yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

        return rows

    points = of_documents(left, fine, "points")
    near = materialize(both(left, points).mapInArrow(passed(may_link), "a bigint, b bigint").distinct(), "pairs")
    release(left, points)
    sets = of_documents(near, lambda own: own.astype("<u8").tobytes(), "sets")
    found = materialize(both(near, sets).mapInArrow(passed(link), "a bigint, b bigint").distinct(), "links")
    release(near, sets)
    return found


def _tree_pairs(num: int, den: int):
    """Candidate pairs of each cell; rows come sorted by cell."""

    def of_cell(block: np.ndarray, keys, comps, sizes, raw: list[bytes]) -> Iterator[np.ndarray]:
        points = np.array([folded(read_point(r), COARSE) for r in raw], np.int64)
        fine, trees = FinePoints(raw), []
        for k in np.unique(block):
            at = np.flatnonzero(block == k)
            at = at[np.unique(keys[at], return_index=True)[1]]  # equal sets are one point
            trees.append((at, CountTree(points[at], sizes[at])))
        (x, tx), (y, ty) = trees[0], trees[-1]
        for found in surviving_pieces(tx, ty if len(trees) == 2 else None, num, den):
            pairs = np.stack([x[found[:, 0]], y[found[:, 1]]], axis=1)
            pairs = pairs[comps[pairs[:, 0]] != comps[pairs[:, 1]]]
            if len(pairs):
                yield keys[fine_survivors(pairs, fine, sizes, num, den)]

    def distinct(found: list[np.ndarray]) -> pa.RecordBatch:
        p = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["a", "b"])

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def out(table) -> Iterator[pa.RecordBatch]:
            shingle, block_a, block_b, block, keys, comps, sizes = (table.column(i).to_numpy() for i in range(7))
            raw = table.column(7).to_pylist()
            new = (np.diff(shingle) != 0) | (np.diff(block_a) != 0) | (np.diff(block_b) != 0)
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(shingle)]
            found, n = [], 0
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                cell = slice(low, high)
                mixed_blocks = block_a[low] != block_b[low]
                if mixed_blocks and len(set(block[cell].tolist())) < 2:
                    continue  # pairs inside one block belong to its own cell
                for pairs in of_cell(block[cell], keys[cell], comps[cell], sizes[cell], raw[low:high]):
                    found.append(pairs)
                    n += len(pairs)
                    if n >= EXPANDED:
                        yield distinct(found)
                        found, n = [], 0
            if n:
                yield distinct(found)

        for batch in parts:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            marks = [held.column(i).to_numpy() for i in range(3)]
            last = np.ones(len(held), bool)
            for m in marks:
                last &= m == m[-1]
            whole = int(np.argmax(last))  # the last cell may go on in the next batch
            if whole:
                yield from out(held.slice(0, whole).combine_chunks())
                held = held.slice(whole)
        if held is not None and len(held):
            yield from out(held.combine_chunks())

    return rows


def _members(known: DataFrame, sent) -> DataFrame:
    """Keys and shingles of all prefixes that the bit map ``sent`` lets through; it misses none that it was made of."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            prefixes = batch.column(1)
            shingle = prefixes.flatten().to_numpy(zero_copy_only=False)
            kept = hits(sent.value, shingle.view(np.uint64), MARK_BITS)
            key = np.repeat(batch.column(0).to_numpy(), pc.list_value_length(prefixes).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(key[kept]), pa.array(shingle[kept])], ["key", "shingle"])

    return known.select("key", "prefix").mapInArrow(rows, "key bigint, shingle bigint")


def links(docs: DataFrame, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Described documents, and the component of each key of a set that links with another."""
    ship_package(docs.sparkSession)
    described = describe(docs, width, num, den)
    known = described.where("key is not null and doc_id is not null")
    classes = materialize(
        known.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n")), "classes"
    )
    members = known.select("key", F.explode("prefix").alias("shingle"))
    # most shingles are alone; what else is asked of a bucket is found for the others only, as all of it is shuffled
    ends = materialize(
        members.groupBy("shingle")
        .agg(F.min("key").alias("least"), F.max("key").alias("most"), F.count(F.lit(1)).alias("m"))
        .where("least <> most"),
        "ends",
    )
    sent = docs.sparkSession.sparkContext.broadcast(bit_map(ends, "shingle", MARK_BITS))
    together = materialize(lookup(_members(known, sent), ends, "shingle"), "together")
    sent.destroy()
    release(ends)
    slim = materialize(described.drop("prefix"), "described")
    release(described)
    described, known = slim, slim.where("key is not null and doc_id is not null")
    buckets = together.groupBy("shingle").agg(
        *[F.min_by("key", F.xxhash64("key", F.lit(i))).alias(f"center{i}") for i in range(CENTERS)]
    )
    buckets = materialize(buckets, "buckets")
    shared = materialize(lookup(together, buckets, "shingle"), "shared")
    release(together, buckets)
    centers = ["least", "most", *[f"center{i}" for i in range(CENTERS)]]
    stars = shared.select(F.explode(F.array(*[F.struct(*_pair("key", c)) for c in centers])).alias("p"))
    first = verify(docs, classes, stars.select("p.*").where("a <> b"), width, num, den)

    def placed(labels: DataFrame, *beside: str) -> DataFrame:
        """Members with their component, and of their buckets only what is read later, as all of it is shuffled."""
        members = shared.select("shingle", "key", *beside).join(labels.withColumnRenamed("node", "key"), "key", "left")
        return members.withColumn("comp", F.coalesce("component", "key")).drop("component")

    # a second round, for those outside the largest component of a bucket, against a few of its members
    labels = components(first)
    release(first)
    inside = materialize(placed(labels), "inside")
    drawn = [F.min_by("key", F.xxhash64("key", "shingle", F.lit(i))).alias(f"d{i}") for i in range(CENTERS + 1)]
    largest = (
        inside.groupBy("shingle", "comp").agg(F.count(F.lit(1)).alias("c"), *drawn)
        .groupBy("shingle").agg(F.max(F.struct("c", "comp", *[f"d{i}" for i in range(CENTERS + 1)])).alias("top"))
        .where("top.c > 2")
    )
    again = inside.select("shingle", "key", "comp").join(largest, "shingle").where("comp <> top.comp")
    again = again.select(F.explode(F.array(*[F.struct(*_pair("key", f"top.d{i}")) for i in range(CENTERS + 1)])).alias("p"))
    second = verify(docs, classes, again.select("p.*"), width, num, den)
    release(inside)
    labels = merged(labels, second)
    release(second)
    inside = materialize(placed(labels, "m", "least", "most"), "inside")
    release(shared)
    # buckets in which some pair is open: more than one component, and more than the two ends
    open_buckets = (
        inside.groupBy("shingle")
        .agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.max((F.col("key") != F.col("least")) & (F.col("key") != F.col("most"))).alias("more"))
        .where("x <> y and more")
        .select("shingle")
    )
    open_buckets = materialize(open_buckets, "open")
    points = known.select("key", "n", "point").dropDuplicates(["key"])
    blocks = F.ceil(F.col("m") / BLOCK)
    cells = (
        lookup(inside, open_buckets, "shingle", "left_semi")
        .select("shingle", "m", "key", "comp")
        .distinct()
        .join(points, "key")
        .withColumn("block", F.pmod(F.xxhash64("key"), blocks))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)))
        .select(
            "shingle", F.least("block", "other").alias("block_a"), F.greatest("block", "other").alias("block_b"),
            "block", "key", "comp", "n", "point",
        )
    )
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = cells.repartition(n, "shingle", "block_a", "block_b").sortWithinPartitions("shingle", "block_a", "block_b")
    more = ordered.mapInArrow(_tree_pairs(num, den), "a bigint, b bigint")
    third = verify(docs, classes, more, width, num, den)
    release(inside, open_buckets, classes)
    labels = merged(labels, third)
    release(third)
    return described, labels


def _cell_links(num: int, den: int):
    """Number of links that each set of a cell has in it, as far as it has any."""

    def rows(table: pa.Table) -> pa.Table:
        block_a, block_b, block = (table.column(c).to_numpy() for c in ("block_a", "block_b", "block"))
        keys, sets = table.column("key").to_numpy(), [np.frombuffer(v.as_py(), "<u8") for v in table.column("v")]
        sizes = np.array([len(own) for own in sets])
        points = np.array([point(own, COARSE) for own in sets], np.int64)
        degree = np.zeros(len(keys), np.int64)
        if block_a[0] == block_b[0]:
            pairs = surviving(CountTree(points, sizes), None, num, den)
        else:
            x, y = np.flatnonzero(block == block_a[0]), np.flatnonzero(block == block_b[0])
            pairs = np.zeros((0, 2), np.int64)
            if len(x) and len(y):
                pairs = surviving(CountTree(points[x], sizes[x]), CountTree(points[y], sizes[y]), num, den)
                pairs = np.stack([x[pairs[:, 0]], y[pairs[:, 1]]], axis=1)
        shingle = np.unique(np.concatenate(sets), return_inverse=True)[1]
        begins = np.concatenate([[0], np.cumsum(sizes)])
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        firsts, low = np.unique(pairs[:, 0], return_index=True)
        before = np.zeros(len(shingle) + 1, np.int64)
        for i, a, b in zip(firsts.tolist(), low.tolist(), [*low[1:].tolist(), len(pairs)], strict=True):
            held = np.zeros(len(shingle), bool)
            held[shingle[begins[i] : begins[i + 1]]] = True
            np.cumsum(held[shingle], out=before[1:])
            others = pairs[a:b, 1]
            shared = before[begins[others + 1]] - before[begins[others]]
            linked = others[shared * (num + den) >= num * (sizes[i] + sizes[others])]
            degree[i] += len(linked)
            degree[linked] += 1
        some = degree > 0
        return pa.table({"key": pa.array(keys[some], pa.int64()), "n": pa.array(degree[some], pa.int64())})

    return rows


def degrees(docs: DataFrame, described: DataFrame, labels: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Number of other sets that each set key links with: key, n_links; ``labels`` are the components of all links."""
    known = described.where("key is not null and doc_id is not null")
    classes = known.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"))
    members = materialize(labels.withColumnRenamed("node", "key").join(classes, "key"), "members")
    texts = lookup(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), members.select("doc_id").distinct(), "doc_id", "left_semi"
    )

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys, values):
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.binary())], ["key", "v"])

        for batch in parts:
            keys, values = [], []
            for _, own in _sets(batch.column(0), width):
                if len(own):
                    keys.append(signature(own))
                    values.append(own.astype("<u8").tobytes())
                if len(keys) == 1024:
                    yield out(keys, values)
                    keys, values = [], []
            yield out(keys, values)

    # the texts of one id may differ, so sets are looked up by their key
    sets = materialize(texts.select("text").mapInArrow(rows, "key bigint, v binary"), "sets")
    blocks = materialize(
        members.groupBy("component")
        .agg(F.greatest(F.ceil(F.count(F.lit(1)) / COUNTED_SETS), F.ceil(F.sum("n") / COUNTED_SHINGLES)).cast("long").alias("blocks")),
        "blocks",
    )
    cells = (
        members.join(blocks, "component")
        .withColumn("block", F.pmod(F.xxhash64("key"), "blocks"))
        .join(sets.dropDuplicates(["key"]), "key")
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("component", F.least("block", "other").alias("block_a"), F.greatest("block", "other").alias("block_b"), "block", "key", "v")
    )
    counted = cells.groupBy("component", "block_a", "block_b").applyInArrow(_cell_links(num, den), "key bigint, n bigint")
    found = materialize(counted.groupBy("key").agg(F.sum("n").alias("n_links")), "degrees")
    release(sets, blocks, members)
    return found


def group(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, count_links: bool = True) -> DataFrame:
    """One row per document (doc_id, text): doc_id, text_hash, n_shingles, component_id, n_links.

    Documents link when the Jaccard similarity of their shingle sets is at least ``num / den``;
    words are lower-cased in ASCII and split at ASCII white space. ``component_id`` is the least
    doc_id that links lead to, its own included; ``n_links`` counts linked other sets and is left out
    without ``count_links``. Null and empty texts have no shingles and link with nothing, nor do rows
    with a null id, whose component is null. Rows with one id and different texts are separate rows.
    """
    described, labels = links(docs, width, num, den)
    classes = described.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"))
    placed = classes.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn(
        "component", F.coalesce("component", "key")
    )
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.join(least, "component").select("key", "component_id")
    columns = ["doc_id", "text_hash", F.col("n").alias("n_shingles")]
    columns.append(F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    if count_links:
        named = named.join(degrees(docs, described, labels, width, num, den), "key", "left")
        columns.append(F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    return described.drop("point", "prefix").join(named, "key", "left").select(*columns)


def one_of_each(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents without those that link, directly or not, to one with a smaller id.

    All columns stay as they are. Documents without shingles and rows with a null id stay. Of
    rows repeated with id and text one stays.
    """
    grouped = materialize(group(docs, width, num, den, count_links=False).where("doc_id is not null and n_shingles > 0"), "grouped")
    row = F.concat_ws(":", "doc_id", "text_hash").alias("_row")
    going = grouped.where("doc_id <> component_id").select(row).distinct()
    again = grouped.where("doc_id = component_id").select(row).groupBy("_row").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    marked = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole"),
        F.concat_ws(":", F.col("doc_id").cast("long"), F.xxhash64("text")).alias("_row"),
    )
    left = lookup(marked, going, "_row", "left_anti")
    again = materialize(again.select("_row"), "repeated")
    single = lookup(left, again, "_row", "left_anti")
    repeated = lookup(left, again, "_row", "left_semi").dropDuplicates(["_row"])
    return single.union(repeated).select("_whole.*")
