"""A Merkle manifest of a table: a tree of fan-out eight a group, and one over the groups.

Leaves are numbered within their group by a range sort, so no group has to fit a task. Aligned runs of up to 8 ** HEIGHT
nodes are blocks; a block is an aligned subtree and is stored as one row whose nodes lie in van Emde Boas order: a tree is
cut at half its height, the top part is laid out first and then each part below it, by the same rule. Where a node lies
follows from its level and number alone (``place``), both when a block is built and when siblings are looked up. The roots
of blocks are the leaves of the next round until a group has one block; the roots of groups make one more tree in the same
way. Proofs come down the same tables: a block hands each of its children the siblings above.
"""

import hashlib
from functools import reduce

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import stored

FAN = 8
HEIGHT = 3  # of a block: up to 512 leaves
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SIBLINGS = "array<struct<left: string, right: string>>"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(fields=FIELDS, change=lambda name: F.col(name)):
    """The hash of a row: of each field ``-`` if null, else its length in bytes, a colon and the value."""

    def part(name):
        value = change(name).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*(part(f) for f in fields)), 256)


# --- the layout ----------------------------------------------------------------------------------


def place(levels, depth, number):
    """Where node ``number`` (an array) at ``depth`` lies in a tree of ``levels`` levels."""
    if levels == 1:
        return np.zeros_like(number)
    top = levels // 2
    if depth < top:
        return place(top, depth, number)
    below = FAN ** (depth - top)
    return size(top) + number // below * size(levels - top) + place(levels - top, depth - top, number % below)


def size(levels):
    """Nodes of a full tree."""
    return (FAN**levels - 1) // (FAN - 1)


def _places(levels, depth):
    """The places of a whole depth; each is worked out once a worker."""
    if (levels, depth) not in _known:
        _known[levels, depth] = place(levels, depth, np.arange(FAN**depth))
    return _known[levels, depth]


_known = {}


def _height(total, most):
    """Of the blocks of a group of ``total`` nodes: ``most``, or less where that leaves one node."""
    h = 0
    while h < most and FAN**h < total:
        h += 1
    return h


class Block:
    """An aligned subtree: digests of 32 bytes at their places; behind the last one that is used nothing is kept."""

    def __init__(self, nodes, n, height):
        self.nodes, self.n, self.height = nodes, n, height

    @classmethod
    def built(cls, leaves, height):
        """``leaves``: digests as hex text. Every run of up to eight nodes becomes the hash of their hex texts."""
        levels = height + 1
        nodes = np.zeros((size(levels), 32), np.uint8)
        row = list(leaves)
        for depth in range(height, -1, -1):
            nodes[_places(levels, depth)[: len(row)]] = np.frombuffer(bytes.fromhex("".join(row)), np.uint8).reshape(-1, 32)
            if depth:
                row = [digest("".join(row[i : i + FAN])) for i in range(0, len(row), FAN)]
        used = 1 + max(int(_places(levels, d)[: -(-len(leaves) // FAN ** (height - d))].max()) for d in range(levels))
        return cls(nodes[:used].tobytes(), len(leaves), height)

    @property
    def root(self):
        return self.nodes[:32].hex()

    def row(self, depth):
        """All nodes of a depth in order, as one hex text."""
        n = -(-self.n // FAN ** (self.height - depth))
        nodes = np.frombuffer(self.nodes, np.uint8).reshape(-1, 32)
        return nodes[_places(self.height + 1, depth)[:n]].tobytes().hex()

    def paths(self):
        """For each leaf the siblings level by level, lowest first: pairs of the texts to its left and to its right."""
        out = [[] for _ in range(self.n)]
        for depth in range(self.height, 0, -1):
            row, below = self.row(depth), FAN ** (self.height - depth)
            for number in range(len(row) // 64):
                run = row[number // FAN * FAN * 64 : (number // FAN + 1) * FAN * 64]
                at = number % FAN * 64
                pair = {"left": run[:at], "right": run[at + 64 :]}
                for path in out[number * below : (number + 1) * below]:
                    path.append(pair)
        return out


def folded(leaf, siblings):
    """The root that follows from a leaf and its siblings, lowest level first."""
    return F.aggregate(siblings, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def proof_text(siblings):
    """All siblings from the lowest level to the root, each level from left to right, as one text."""
    return F.array_join(F.transform(siblings, lambda s: F.concat(s["left"], s["right"])), "")


# --- the table -----------------------------------------------------------------------------------


def positions(rows):
    """``rows`` (grp, ord, leaf, key) with ``pos``, their number within the group by ord (null first) and leaf, and ``total``, the rows of the group.

    Rows are sorted by ranges, counted as they pass by, and written; what a range lacks is the number of rows of its group
    in the ranges before it. Group sizes play no part.
    """
    order = [F.col("grp").asc_nulls_first(), F.col("ord").asc_nulls_first(), F.col("leaf")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("grp", "leaf", "key", F.spark_partition_id().alias("range"))
    schema = T.StructType([*ranged.schema, T.StructField("at", T.LongType())])

    def number(batches):
        import pyarrow as pa

        seen, last = -1, None
        for batch in batches:
            at = []
            for g in batch.column("grp").to_pylist():
                seen = seen + 1 if g == last and seen >= 0 else 0
                last = g
                at.append(seen)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], schema.names)

    counted = stored(ranged.mapInArrow(number, schema))
    ranges = counted.groupBy("grp", "range").agg(F.count("*").alias("n"))
    group = Window.partitionBy("grp")
    before = F.sum("n").over(group.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = stored(ranges.select(F.col("grp").alias("g"), F.col("range").alias("r"), F.coalesce(before, F.lit(0)).alias("start"), F.sum("n").over(group).alias("total")))
    joined = counted.join(starts, F.col("grp").eqNullSafe(F.col("g")) & (F.col("range") == F.col("r")))
    return joined.select("grp", (F.col("start") + F.col("at")).alias("pos"), "total", "leaf", "key")


class Tree:
    """The blocks of all groups, round by round: ``rounds[k]`` is a stored table of blocks whose leaves are the roots of round k - 1."""

    def __init__(self, leaves, height=HEIGHT):
        """``leaves``: grp, pos, total, leaf and a key of any type, which comes back with the proof."""
        self.height, self.span = height, FAN**height
        most = leaves.agg(F.max("total")).first()[0] or 0
        self.rounds = [stored(self._blocks(leaves))]
        while (most := -(-most // self.span)) > 1:
            above = F.ceil(F.col("total") / F.lit(self.span)).cast("long")
            nodes = self.rounds[-1].select("grp", F.col("block").alias("pos"), above.alias("total"), F.col("root").alias("leaf"), F.lit(None).cast("int").alias("key"))
            self.rounds.append(stored(self._blocks(nodes.filter("total > 1"))))

    def _blocks(self, leaves):
        key = leaves.schema["key"].dataType.simpleString()
        schema = f"grp string, block long, total long, nodes binary, root string, keys array<{key}>"
        height = self.height

        def build(group, rows):
            import pyarrow as pa

            rows = rows.sort_by("pos").combine_chunks()
            total = rows["total"][0].as_py()
            made = Block.built(rows["leaf"].to_pylist(), _height(total, height))
            keys = pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows["key"].chunk(0))
            columns = [[group[0].as_py()], [group[1].as_py()], [total], [made.nodes], [made.root]]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            return pa.Table.from_arrays([*map(pa.array, columns, kinds), keys], ["grp", "block", "total", "nodes", "root", "keys"])

        block = F.floor(F.col("pos") / F.lit(self.span)).cast("long")
        return leaves.withColumn("block", block).groupBy("grp", "block").applyInArrow(build, schema)

    def roots(self):
        """grp, root of every group."""
        return reduce(lambda a, b: a.unionByName(b), (r.filter(F.col("total") <= self.span).select("grp", "root") for r in self.rounds))

    def proofs(self, above):
        """key, leaf, siblings and root of every leaf. ``above``: grp, root and the siblings over that root.

        A block of a group that has no other takes them from ``above``, any other block from the round that its root went into.
        """
        given = above.select("grp", F.lit(0).cast("long").alias("block"), "root", "siblings")
        handed = None
        for k in range(len(self.rounds) - 1, -1, -1):
            alone = F.col("total") <= self.span
            blocks = self.rounds[k].drop("root")
            rows = _beside(blocks.filter(alone), given)
            if handed is not None:
                rows = rows.unionByName(_beside(blocks.filter(~alone), handed))
            key = blocks.schema["keys"].dataType.elementType.simpleString()
            found = rows.mapInArrow(_looked_up(self.height), f"grp string, pos long, key {key}, leaf string, siblings {SIBLINGS}, root string")
            if k:
                handed = stored(found.select("grp", F.col("pos").alias("block"), "root", "siblings"))
        return found.select("grp", "key", "leaf", "siblings", "root")


def _looked_up(height):
    """A map from blocks beside their paths to their leaves with all siblings."""
    names = ["grp", "pos", "key", "leaf", "siblings", "root"]

    def look(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in ("grp", "block", "total", "nodes", "keys", "siblings", "root")}
                keys, above = row["keys"].values, row["siblings"].as_py()
                n, first = len(keys), row["block"].as_py() * FAN**height
                block = Block(row["nodes"].as_py(), n, _height(row["total"].as_py(), height))
                leaves = block.row(block.height)
                columns = [
                    pa.array([row["grp"].as_py()] * n, pa.string()),
                    pa.array(range(first, first + n), pa.int64()),
                    keys,
                    pa.array([leaves[at : at + 64] for at in range(0, 64 * n, 64)], pa.string()),
                    pa.array([path + above for path in block.paths()], kind),
                    pa.array([row["root"].as_py()] * n, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return look


def _beside(blocks, paths):
    """Blocks with what lies above them; both sides hold a block once."""
    other = paths.select(F.col("grp").alias("g"), F.col("block").alias("b"), "siblings", "root")
    return blocks.join(other, F.col("grp").eqNullSafe(F.col("g")) & (F.col("block") == F.col("b"))).drop("g", "b")


class Manifest:
    """The trees of a table: ``root`` is that of all rows, None for an empty table."""

    def __init__(self, rows, leaf, group="lang", order="doc_id", keep=(), height=HEIGHT):
        """``rows`` by the groups of ``group`` (null is one) in the order of ``order`` (nulls first, ties by the leaf).

        ``leaf`` is the column expression of a row's hash; the columns ``keep`` (names or expressions) come back with the
        proofs; one named like a column of the proofs (in any letter case) does not. Equal rows are leaves of their own and may
        come in any order, as their hashes are the same. Texts of any length count whole.
        """
        key = F.struct(F.lit(0).alias("__none"), *keep)
        columns = [F.col(f"`{group}`").cast("string").alias("grp"), F.col(f"`{order}`").alias("ord"), leaf.alias("leaf"), key.alias("key")]
        self.groups = Tree(positions(rows.select(*columns)), height)
        subroots = stored(self.groups.roots())
        nothing = F.lit(None).cast("string")
        top = subroots.select(nothing.alias("grp"), F.col("grp").alias("ord"), F.col("root").alias("leaf"), F.struct(F.col("grp").alias("name")).alias("key"))
        self.top = Tree(positions(top), height)
        root = self.top.roots().first()
        self.root = root.root if root else None

    def proofs(self):
        """A row for each row of the table: what was kept, ``leaf``, ``subroot``, ``root`` and ``siblings``, from the lowest level to the
        root pairs of hex texts to the left and to the right (empty at a level without siblings)."""
        spark = self.groups.rounds[0].sparkSession
        none = spark.range(1).select(F.lit(None).cast("string").alias("grp"), F.lit(self.root).cast("string").alias("root"), F.array().cast(SIBLINGS).alias("siblings"))
        over = self.top.proofs(stored(none)).select(F.col("key.name").alias("grp"), F.col("leaf").alias("root"), "siblings")
        found = self.groups.proofs(stored(over))
        own = ("leaf", "subroot", "root", "siblings", "__none")
        kept = [F.col("key")[f.name].alias(f.name) for f in found.schema["key"].dataType if f.name.lower() not in own]
        return found.select(*kept, "leaf", F.col("root").alias("subroot"), F.lit(self.root).cast("string").alias("root"), "siblings")
