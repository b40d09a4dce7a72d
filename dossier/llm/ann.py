"""Approximate nearest neighbours by collision-counting hashing with query-aware windows.

Every vector is projected on ``projections`` random lines and each line of a shard is a sorted array. A query's
windows are centred on its own projections. They start narrow and are widened by a factor again and again (virtual
rehashing: no array is ever rebuilt); a vector that lies in the windows of at least ``threshold`` lines has collided
often enough and is verified by its true distance. A query is done with a shard when the k-th verified distance is
below the radius that the windows stand for, or when the windows hold everything.

The index is sharded: every partition holds the sorted arrays of its rows, a bounded number at a time, so all rows
are indexed and none is moved. The query set is stated and goes to all shards in blocks of bounded size; of each shard a
query keeps ``k`` rows, which are merged by an aggregation that takes the k best on the map side first.
"""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

PROJECTIONS, THRESHOLD = 56, 0.53  # lines, and the share of them on which a candidate has to collide
WIDTH, WIDEN = 0.9, 1.2  # half a window in units of the radius, and the step of virtual rehashing
SHARD, BLOCK = 20_000, 2_000  # vectors of a shard, queries of a block
CHUNK = 64  # queries that are counted at once


def search(vectors, queries, k=10, id="vec_id", vector="embedding", seed=11):
    """(``query_id``, ``rank``, id, ``score``): for each query its ``k`` nearest of the vectors found, but not itself.

    ``queries`` has the columns of ``vectors``. The score is the Euclidean distance of the stored numbers in double
    precision; ties go to the smaller id. Vectors that are null, empty, all zero or hold a null or a number that is
    not finite take no part, neither as query nor as candidate; so do null ids, and vectors whose length differs from
    the query's. Rows that repeat an id are candidates each, rows with the query's id are not. A query of fewer than
    ``k`` candidates gets them all.
    """
    kind = vectors.schema[id].dataType.simpleString()
    usable = lambda df: df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).filter(_sound("v") & F.col("id").isNotNull())
    rows, asked, out = usable(vectors), usable(queries), None
    for block in _blocks(asked.withColumn("n", F.size("v"))):
        sent = vectors.sparkSession.sparkContext.broadcast(block)
        found = rows.mapInArrow(_shards(sent, k, seed), f"query_id {kind}, score double, id {kind}")
        best = Window.partitionBy("query_id").orderBy("score", "id")
        top = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        out = top if out is None else out.unionAll(top)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], f"query_id {kind}, score double, id {kind}, rank int")
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id), "score")


def _sound(name):
    v = F.col(name)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _blocks(asked):
    """Blocks of distinct query ids with their vectors, by the length of the vectors. Of rows that repeat a query's id
    and vector one is asked; other vectors of the id are queries of that id too."""
    block = {}
    for row in asked.select("id", "v", "n").distinct().toLocalIterator():
        ids, values = block.setdefault(row.n, ([], []))
        ids.append(row.id)
        values.append(row.v)
        if len(ids) == BLOCK:
            yield {row.n: (np.array(ids), np.array(values))}
            del block[row.n]
    for n, (ids, values) in block.items():
        yield {n: (np.array(ids), np.array(values))}


def _shards(sent, k, seed):
    import pyarrow as pa

    def answer(ids, flat, dim):
        if dim not in sent.value:
            return
        shard = Shard(np.concatenate(ids), np.concatenate(flat), seed)
        asked, queries = sent.value[dim]
        for i in range(0, len(asked), CHUNK):
            found = shard.nearest(asked[i : i + CHUNK], queries[i : i + CHUNK], k)
            if len(found[0]):
                yield pa.record_batch([pa.array(x) for x in found], names=["query_id", "score", "id"])

    def run(batches):
        held = {}  # by length: ids, vectors
        for batch in batches:
            lists = batch["v"]
            offsets = np.asarray(lists.offsets)
            flat, size, ids = np.asarray(lists.flatten()), np.diff(offsets), np.asarray(batch["id"])
            for dim in np.unique(size):
                some = np.flatnonzero(size == dim)
                values = flat[(offsets[some] - offsets[0])[:, None] + np.arange(dim)]
                for i in range(0, len(some), SHARD):
                    mine = held.setdefault(int(dim), ([], []))
                    mine[0].append(ids[some[i : i + SHARD]])
                    mine[1].append(values[i : i + SHARD])
                    if sum(map(len, mine[0])) >= SHARD:
                        yield from answer(*held.pop(int(dim)), int(dim))
        for dim, mine in held.items():
            yield from answer(*mine, dim)

    return run


class Shard:
    """Sorted projections of some vectors."""

    def __init__(self, ids, vectors, seed):
        self.ids, self.vectors = ids, vectors
        lines = np.random.default_rng(seed).normal(size=(vectors.shape[1], PROJECTIONS))
        self.lines = lines
        values = vectors @ lines
        self.order = np.argsort(values, axis=0, kind="stable").T.copy()
        ordered = np.take_along_axis(values.T, self.order, axis=1)
        # one array for all lines, each moved beyond the one before it, so that windows of all lines are found at once
        self.reach = 4 * max(1.0, np.abs(ordered).max())
        self.shift = np.arange(PROJECTIONS) * self.reach
        self.flat = (ordered + self.shift[:, None]).ravel()
        self.start = max(values.std(axis=0).mean(), 1e-9) / 2

    def _places(self, values):
        """Where values stand in the arrays of their lines."""
        base = np.arange(PROJECTIONS) * len(self.ids)
        return np.searchsorted(self.flat, np.clip(values, -self.reach / 2.01, self.reach / 2.01) + self.shift) - base

    def nearest(self, asked, queries, k):
        """Query ids, distances and ids of the k nearest of each query that were verified, as three arrays."""
        n, m, need = len(self.ids), len(asked), int(np.ceil(THRESHOLD * PROJECTIONS))
        centre, radius = queries @ self.lines, self.start
        left = self._places(centre)
        right = left.copy()
        count = np.zeros((m, n), np.int16)
        done = self.ids[None, :] == asked[:, None]
        near = [np.zeros(0, np.int64)] * m
        distance = [np.zeros(0)] * m
        active = np.arange(m)
        while len(active):
            lo = np.minimum(self._places(centre[active] - WIDTH * radius), left[active])
            hi = np.maximum(self._places(centre[active] + WIDTH * radius), right[active])
            for i, q in enumerate(active):
                bounds = zip(self.order, lo[i], left[q], right[q], hi[i], strict=True)
                new = [x for order, a, b, c, d in bounds for x in (order[a:b], order[c:d])]
                count[q] += np.bincount(np.concatenate(new), minlength=n).astype(np.int16)
                some = np.flatnonzero((count[q] >= need) & ~done[q])
                done[q, some] = True
                gap = self.vectors[some] - queries[q]
                near[q] = np.concatenate([near[q], some])
                distance[q] = np.concatenate([distance[q], np.sqrt((gap * gap).sum(axis=1))])
            left[active], right[active] = lo, hi
            active = np.array([q for q in active if not done[q].all() and (len(near[q]) < k or np.partition(distance[q], k - 1)[k - 1] > radius)], np.int64)
            radius *= WIDEN
        best = [np.lexsort((self.ids[x], d))[:k] for x, d in zip(near, distance, strict=True)]
        sizes = [len(b) for b in best]
        return np.repeat(asked, sizes), np.concatenate([d[b] for d, b in zip(distance, best, strict=True)]), np.concatenate([self.ids[x[b]] for x, b in zip(near, best, strict=True)])
