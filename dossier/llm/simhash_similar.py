"""Near-duplicates by a wanted similarity: wide SimHashes, whose parts are linked by binary trie self-joins.

A fingerprint has ``WIDE`` words of 64 bits. Two texts whose shingles have Jaccard similarity s differ in a share of
acos(2s / (1 + s)) / pi of the bits, so the wanted similarity gives the number of bits by which linked fingerprints may
differ. Fingerprints that near are found in ``VIEWS`` parts of 32 bits, each a trie of its own that is joined with itself
within ``BUDGET`` bits; of pairs found the whole fingerprints are compared. At a similarity of 0.8 one view finds 0.27 of
the pairs and one of eight 0.92, at 0.85 0.98, at 0.9 0.998.

Hot groups: equal fingerprints are one row. Fingerprints that agree in all but two bits of their first word are first made
components by the trie of ``simhash_dedup``; in a view each value of such a component is one row. So a large group of
near copies adds as many rows to a view as it has different values there, and its members are not compared again.
"""

import math

import numpy as np
from pyspark.sql import functions as F

from .shared import stored
from .simhash_dedup import _pairs, _split, components, fingerprinted, linked, one_each, whole_cells

WIDE = 4  # words of a fingerprint
PART = 32  # bits of a view
VIEWS = WIDE * 64 // PART
BUDGET = 3  # differing bits in a view
TURNS = range(0, PART, PART // (BUDGET + 1))  # of two values within the budget, one of these rotations has equal first bits
CELL = 32768  # rows of a cell that are joined in one task
STEPS = (PART - PART // (BUDGET + 1)) // 4  # times that a cell can be split
WORDS = ["fp", *(f"fp{i}" for i in range(1, WIDE))]


def distance(similarity):
    """The expected number of differing bits of two fingerprints of a similarity."""
    return WIDE * 64 * math.acos(2 * similarity / (1 + similarity)) / math.pi


def similar_groups(marked, shingle=5, similarity=0.8):
    """``row``, ``id`` and ``root``, which names its group, for each ``row``, ``id`` and ``text``.

    Links are made between texts whose estimated similarity is ``similarity`` or more, groups are their components. Null texts
    and those without words are equal, a text of fewer than ``shingle`` words is one shingle; repeated rows are in one group.
    Whole texts of any length count; an empty table has no groups.
    """
    prints = stored(fingerprinted(marked, shingle=shingle, wide=WIDE))
    nodes = stored(prints.select(WORDS).distinct())
    tight = components(linked(nodes.select("fp").distinct()))
    nodes = stored(nodes.join(tight, F.col("fp") == F.col("node"), "left").select(*WORDS, F.coalesce("root", "fp").alias("part")))
    loose = components(_links(nodes, similarity)).withColumnRenamed("root", "whole")
    parts = nodes.select("fp", "part").distinct().join(loose, F.col("part") == F.col("node"), "left")
    return prints.select("row", "id", "fp").join(stored(parts.select("fp", F.coalesce("whole", "part").alias("root"))), "fp").drop("fp")


def distinct_documents(docs, id="doc_id", text="text", shingle=5, similarity=0.8):
    """The rows of ``docs`` that stay if one of each of the ``similar_groups`` does: that of the smallest id, of equal ids the first.
    All columns stay, whatever their names."""
    return one_each(docs, id, text, lambda marked: similar_groups(marked, shingle, similarity))


def _links(nodes, similarity):
    """Links (``u``, ``v``) that join all parts of which some fingerprints were found and are near enough; not every such pair."""
    halves = [(F.col(WORDS[i // 2]) if i % 2 == 0 else F.shiftleft(WORDS[i // 2], PART)).bitwiseAND(F.lit(-1 << PART)) for i in range(VIEWS)]
    views = nodes.select("part", F.struct(WORDS).alias("words"), F.posexplode(F.array(*halves)).alias("view", "v"))
    rows = views.groupBy("view", "part", "v").agg(F.min("words").alias("words"))
    turned = [_turned(F.col("v"), t) for t in TURNS]
    rows = rows.select("view", "part", "words.*", F.posexplode(F.array(*turned)).alias("t", "v"))
    cells = rows.withColumn("turn", F.col("view") * len(TURNS) + F.col("t")).withColumn("depth", F.lit(PART // len(TURNS)))
    cells = cells.withColumn("a", F.expr("shiftrightunsigned(v, 64 - depth)"))
    key, carried = ["turn", "depth", "a", "b"], ["part", *WORDS]
    cells = stored(cells.select("turn", "depth", "a", F.col("a").alias("b"), F.lit(0).alias("side"), F.lit(0).alias("used"), "v", *carried))
    done = []
    for _ in range(STEPS):
        large = stored(cells.groupBy(*key).count().filter(F.col("count") > CELL).drop("count"))
        if not large.take(1):
            break
        done.append(cells.join(large, key, "left_anti"))
        cells = stored(_split(cells.join(large, key, "left_semi"), BUDGET, carried))
    for other in done:
        cells = cells.unionByName(other)
    dealt = cells.repartition(*key).sortWithinPartitions(*key, "side", "v")
    return dealt.mapInArrow(_joined(distance(similarity)), "u long, v long")


def _turned(value, left):
    """The first ``PART`` bits rotated; the others stay zero."""
    if left == 0:
        return value
    return F.shiftleft(value, left).bitwiseOR(F.shiftrightunsigned(value, PART - left).bitwiseAND(F.lit(-1 << PART)))


def _joined(most):
    def run(batches):
        import pyarrow as pa

        for rows, bounds in whole_cells(batches, ("part", *WORDS)):
            names, part = np.unique(rows["part"], return_inverse=True)
            root = _united(rows, bounds, part, most)
            some = np.flatnonzero(root != np.arange(len(root)))
            if len(some):
                yield pa.record_batch([pa.array(names[some]), pa.array(names[root[some]])], names=["u", "v"])

    return run


def _united(rows, bounds, part, most):
    """The root of each part, after parts that have, in a cell, fingerprints at most ``most`` bits apart are united."""
    root = np.arange(part.max() + 1)
    if len(root) == 1:
        return root
    words = [rows[c].view(np.uint64) for c in WORDS]
    for i, j in _pairs(rows["v"].view(np.uint64), rows["side"], bounds, PART, BUDGET):
        apart = root[part[i]] != root[part[j]]
        i, j = i[apart], j[apart]
        near = sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int32) for w in words) <= most
        x, y = part[i[near]], part[j[near]]
        while len(x):  # hook the larger root below the smaller one, then shorten the paths
            p, q = root[x], root[y]
            apart = p != q
            x, y, p, q = x[apart], y[apart], p[apart], q[apart]
            np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
            while (root[root] != root).any():
                root = root[root]
    return root
