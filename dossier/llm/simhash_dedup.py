"""Near-duplicates by SimHash, linked by a binary trie self-join.

Distinct fingerprints are the leaves of a binary trie. Two nodes are visited together, differing bits add up on
the way down, and a pair of nodes is left as soon as the sum exceeds the budget. To spread the work, three tries
are built over three rotations of the bits: of two fingerprints with at most two differing bits, one of three
blocks is equal, so in that rotation both lie below one node at the end of the block. Such a node is a cell, and
cells are joined by the tasks in which they fall. A cell with too many leaves for a task is replaced by the pairs
of nodes four levels below it, again and again, so no task ever holds more than ``CELL`` fingerprints of a cell.

Links of one task are reduced to a spanning forest before they are shuffled. Components are then found by
alternating star contractions; texts are never moved after they have been fingerprinted.
"""

import functools

import numpy as np
from pyspark.sql import functions as F

from .shared import by_place, named, numbered, stored
from .textops import mix, slices, widened

BITS, BUDGET = 64, 2
BLOCKS = (22, 21, 21)
CELL = 8192  # fingerprints of a cell that are joined in one task
PIECE = 1 << 20  # pairs of leaves that are compared at a time
LEAF = 64  # pairs of leaves below two nodes that are compared without going further down
STEP = 4  # levels by which a large cell is split


def fingerprinted(docs, text="text", shingle=3, wide=1):
    """``docs`` with the SimHash ``fp`` (long, the 64 bits) of its ASCII-lower-cased text in place of the text.

    A text of fewer than ``shingle`` words is one shingle, a null text or one without words has fingerprint 0.
    With ``wide`` above 1, ``fp1`` and so on hold 64 more bits each, of other hashes.
    """
    added = ["fp", *(f"fp{i}" for i in range(1, wide))]
    rest, shape = widened([f for f in docs.schema if f.name != text], ", ".join(f"{c} long" for c in added))
    return docs.mapInArrow(_fingerprint(text, shingle, rest, added), shape)


def _fingerprint(text, shingle, names, added):
    import pyarrow as pa

    def run(batches):
        import xxhash

        digest = functools.partial(xxhash.xxh64_intdigest, seed=42)
        for batch in batches:
            for part in slices(batch, text):
                hashes, counts = [], []
                for value in part[text].to_pylist():
                    tokens = value.encode().lower().split() if value else []
                    if len(tokens) <= shingle:
                        hashes.extend([digest(b" ".join(tokens))] if tokens else [])
                        counts.append(min(len(tokens), 1))
                        continue
                    line = b" ".join(tokens)
                    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
                    starts = [0, *(ends[: -shingle] + 1).tolist()]
                    hashes.extend([digest(line[s:e]) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)])
                    counts.append(len(starts))
                hashes, counts = np.array(hashes, np.uint64), np.array(counts)
                prints = [_majority(mix(hashes + np.uint64(i)) if i else hashes, counts) for i in range(len(added))]
                yield pa.record_batch([*(part[c] for c in names), *map(pa.array, prints)], names=[*names, *added])

    return run


def _majority(hashes, counts):
    """The bits that are set in over half of each run of hashes."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        first = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        out[some] = np.packbits(votes * 2 > counts[some][:, None], axis=1).view(">u8").ravel().astype(np.uint64)
    return out.view(np.int64)


def linked(fps, cell=CELL):
    """Links (``u``, ``v``) that join all of the distinct longs ``fp`` that differ in at most two bits; not every such pair."""
    shifts = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    turns = F.explode(F.array(*(F.struct(F.lit(i).alias("turn"), _rotated("fp", s).alias("v"), F.lit(b).alias("depth")) for i, (s, b) in enumerate(zip(shifts, BLOCKS, strict=True)))))
    cells = fps.select(turns.alias("x")).select("x.*").withColumn("a", F.expr("shiftrightunsigned(v, 64 - depth)"))
    cells = cells.select("turn", "depth", "a", F.col("a").alias("b"), F.lit(0).alias("side"), F.lit(0).alias("used"), "v")
    key, done = ["turn", "depth", "a", "b"], []
    while True:
        large = stored(cells.groupBy(*key).count().filter(F.col("count") > cell).drop("count"))
        if not large.take(1):
            break
        done.append(cells.join(large, key, "left_anti"))
        cells = stored(_split(cells.join(large, key, "left_semi")))
    for part in done:
        cells = cells.unionByName(part)
    joined = cells.repartition(*key).sortWithinPartitions(*key, "side", "v").mapInArrow(_traverse, "turn int, u long, v long")
    back = [_rotated(c, (BITS - s) % BITS) for c in "uv" for s in shifts]
    pick = lambda i: F.when(F.col("turn") == 0, back[i]).when(F.col("turn") == 1, back[i + 1]).otherwise(back[i + 2])
    return joined.select(pick(0).alias("u"), pick(3).alias("v"))


def _rotated(name, left):
    c = F.col(name)
    return c if left == 0 else F.shiftleft(c, left).bitwiseOR(F.shiftrightunsigned(c, BITS - left))


def _split(cells, budget=BUDGET, carried=()):
    """The rows of large cells in the pairs of nodes ``STEP`` levels further down that keep within the budget."""
    digit = F.expr(f"cast(shiftrightunsigned(v, {BITS - STEP} - depth) & {2**STEP - 1} as int)")
    others = F.array(*map(F.lit, range(2**STEP)))
    rows = cells.withColumn("d", digit).withColumn("e", F.explode(others)).withColumn("used", F.col("used") + F.expr("bit_count(d ^ e)"))
    rows = rows.filter(F.col("used") <= budget)
    below = lambda node, c: F.shiftleft(node, STEP).bitwiseOR(F.col(c))
    own, low = F.col("side") == 0, F.col("d") < F.col("e")
    first = (own & (F.col("d") <= F.col("e"))) | (F.col("side") == 1)
    side = F.when(own, F.when(F.col("d") == F.col("e"), 0).when(low, 1).otherwise(2)).otherwise(F.col("side"))
    a = F.when(first, below("a", "d")).otherwise(below("a", "e"))
    b = F.when(first, below("b", "e")).otherwise(below("b", "d"))
    return rows.select("turn", (F.col("depth") + STEP).alias("depth"), a.alias("a"), b.alias("b"), side.alias("side"), "used", "v", *carried)


def _traverse(batches):
    import pyarrow as pa

    for rows, bounds in whole_cells(batches):
        yield _forest(pa, rows, bounds)


def whole_cells(batches, more=()):
    """The columns of whole cells of a sorted partition, some at a time, and where each begins and ends; the rows of one cell may span batches."""
    held = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        new = {c: np.asarray(batch[c]) for c in ("turn", "depth", "a", "b", "side", "v", *more)}
        held = new if held is None else {c: np.concatenate([held[c], new[c]]) for c in new}
        key = [held[c] for c in ("turn", "depth", "a", "b")]
        change = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in key])) + 1
        if len(change):
            cut = change[-1]
            yield {c: x[:cut] for c, x in held.items()}, np.concatenate([[0], change])
            held = {c: x[cut:] for c, x in held.items()}
    if held is not None:
        yield held, np.array([0, len(held["v"])])


def _forest(pa, rows, bounds):
    found = list(_pairs(rows["v"].view(np.uint64), rows["side"], bounds))
    left, right = (np.concatenate(x) for x in zip(*found, strict=True)) if found else ((), ())
    root = np.arange(len(rows["v"]))
    while len(left):  # hook the larger root below the smaller one, then shorten the paths
        x, y = root[left], root[right]
        apart = x != y
        if not apart.any():
            break
        left, right = left[apart], right[apart]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root[root] != root).any():
            root = root[root]
    some = np.flatnonzero(root != np.arange(len(root)))
    return pa.record_batch([pa.array(rows["turn"][some]), pa.array(rows["v"][some]), pa.array(rows["v"][root[some]])], names=["turn", "u", "v"])


def _pairs(v, side, bounds, bits=BITS, budget=BUDGET):
    """Index pairs, piece by piece, of values at most ``budget`` bits apart in each run ``bounds[i]:bounds[i+1]``, sorted by
    side and value. Only the first ``bits`` bits of a value may be set."""
    lo, hi = bounds[:-1], bounds[1:]
    sums = [np.concatenate([[0], np.cumsum(side <= s)]) for s in (0, 1)]
    n0 = sums[0][hi] - sums[0][lo]
    n1 = sums[1][hi] - sums[1][lo] - n0
    # a node pair is two ranges of rows; both ranges of a cell of its own are the same
    own = n0 > 1
    two = (n1 > 0) & (n1 + n0 < hi - lo) & (n0 == 0)
    front = [np.concatenate([lo[own], lo[two]]), np.concatenate([hi[own], (lo + n1)[two]]), np.concatenate([lo[own], (lo + n1)[two]]), np.concatenate([hi[own], hi[two]])]
    front.append(np.zeros(len(front[0]), np.int64))
    for depth in range(bits + 1):
        a0, a1, b0, b1, used = front
        small = ((a1 - a0) * (b1 - b0) <= LEAF) | (depth == bits)
        if small.any():
            for i, j in _products(a0[small], a1[small], b0[small], b1[small]):
                near = (i < j) & (np.bitwise_count(v[i] ^ v[j]) <= budget)
                if near.any():
                    yield i[near], j[near]
        if small.all():
            break
        a0, a1, b0, b1, used = (x[~small] for x in front)
        ones = np.concatenate([[0], np.cumsum((v >> np.uint64(BITS - 1 - depth)) & np.uint64(1), dtype=np.int64)])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = (a0 == b0) & (a1 == b1)
        children = [(a0, am, b0, bm, used), (am, a1, bm, b1, used), (a0, am, bm, b1, used + 1), tuple(x[~same] for x in (am, a1, b0, bm, used + 1))]
        front = [np.concatenate(x) for x in zip(*children, strict=True)]
        live = (front[0] < front[1]) & (front[2] < front[3]) & (front[4] <= budget)
        live &= ~((front[0] == front[2]) & (front[1] == front[3]) & (front[1] - front[0] == 1))
        front = [x[live] for x in front]


def _products(a0, a1, b0, b1):
    """All index pairs of ranges a and b, about ``PIECE`` at a time."""
    of, i = _indices(a0, a1)
    ends = np.cumsum((b1 - b0)[of])
    cuts = np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, PIECE), "right")
    for s, e in zip(cuts, [*cuts[1:], len(i)], strict=True):
        which, j = _indices(b0[of[s:e]], b1[of[s:e]])
        yield i[s:e][which], j


def _indices(low, high):
    """The indices in the ranges, and the range of each."""
    size = high - low
    of = np.repeat(np.arange(len(size)), size)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + low[of]


def components(links):
    """(``node``, ``root``) for each node of the links (``u``, ``v``) but the roots, the smallest of their components.

    Large-star and small-star in turn; the links after each round are a stored table. Minima are taken with partial
    aggregation, and the rows of a hub meet its minimum in a join that the adaptive planner can split. Links that are stars
    already, each node below one root that is below none, need no further round.
    """
    ordered = lambda df: df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()
    edges = stored(ordered(links))
    while not _stars(edges):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = ordered(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        near = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        edges = stored(ordered(near.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v"))))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _stars(edges):
    """Whether each ``u`` has one ``v`` and no ``v`` is a ``u``."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("below")), F.struct(F.col("v").alias("x"), F.lit(0).alias("below")))).alias("e")).select("e.*")
    return ends.groupBy("x").agg(F.sum("below").alias("n"), F.min("below").alias("top")).filter("n > 1 or n = 1 and top = 0").isEmpty()


def near_duplicates(docs, id="doc_id", text="text", shingle=3):
    """One row for each row of ``docs``: its id, ``fp``, ``component_id``, ``root`` and ``row``, its number in the table.

    ``component_id`` is the smallest id that is reachable over links of at most two differing bits; null ids are
    rows like others but never the smallest unless all are null. ``root`` names the component.
    """
    return _grouped(numbered(pair(docs, id, text), "row"), id, shingle)


def pair(docs, id, text):
    """Two columns of ``docs`` as ``id`` and ``text``."""
    return docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))


def _grouped(marked, id, shingle):
    prints = stored(fingerprinted(marked, shingle=shingle))
    nodes = stored(prints.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(linked(nodes.select("fp")))
    placed = stored(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = stored(placed.groupBy("root").agg(F.min("least").alias("component_id")))
    label = stored(placed.join(least, "root").select("fp", "root", "component_id"))
    return prints.join(label, "fp").select(F.col("id").alias(id), "fp", "component_id", "root", "row")


def deduplicated(docs, id="doc_id", text="text", shingle=3):
    """The rows of ``docs`` that stay if one of each component does: that of the smallest id, of equal ids the first."""
    return one_each(docs, id, text, lambda marked: _grouped(marked, "id", shingle))


def one_each(docs, id, text, grouped):
    """The rows of ``docs`` that stay if one of each group does: that of the smallest id, of equal ids the first. ``grouped`` finds
    ``id``, ``row`` and the ``root`` of its group for each ``row``, ``id`` and ``text``.

    The rows to drop are the shorter list, so it is these that meet the texts.
    """
    rows, names = by_place(docs)
    keyed = numbered(rows)
    groups = grouped(keyed.select(F.col("__row").alias("row"), F.col(names[id]).alias("id"), F.col(names[text]).alias("text")))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    several = groups.groupBy("root").agg(F.min(order).alias("x"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = stored(several.select("root", F.col("x.row").alias("first")))
    dropped = stored(groups.join(first, "root").filter(F.col("row") != F.col("first")).select(F.col("row").alias("__row")))
    return named(keyed.join(dropped, "__row", "left_anti"), names)
