"""Conflict-constrained best-fit packing of documents into sequences.

A document is cut into pieces of at most ``capacity`` words. Pieces are placed longest first; the open bins of a
pool are ordered by what is left in them and carry two bitmaps, one of the sources and one of the duplicate
clusters they hold. The search starts at the smallest residual that takes the piece and goes to the next larger
one until a bin shares neither bitmap with the piece; so each piece goes into its tightest compatible bin.

Pieces are dealt to pools by a hash of their row, so a source with a third of all rows is spread evenly. The number
of pools follows the number of pieces, so a pool is bounded; bins do not cross pools.
"""

import bisect

import pandas as pd
from pyspark.sql import functions as F

from .shared import stored

POOL = 5000  # pieces of a pool
WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "id {id}, piece int, first_word long, n_words int, bin_id long, bin_offset int"


def pack(docs, id="doc_id", text="text", source="source", capacity=2048, pool=POOL):
    """One row for each piece: ``id``, ``piece`` from 0, ``first_word``, ``n_words``, ``bin_id`` and ``bin_offset``.

    A bin holds at most ``capacity`` words, at most one piece of a source and at most one piece of a group of
    equal texts. A null source is compatible with every other. A null or empty text is a piece of no words; it
    takes a place in a bin like any other. Repeated rows are documents of one duplicate cluster. Pieces of one
    document share their source and their cluster, so they go to different bins.
    """
    words = F.regexp_count(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(WORD)).cast("long")
    cluster = F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    sized = docs.select(F.col(f"`{id}`").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(f"`{source}`").cast("string").alias("source"), words.alias("n"), cluster.alias("cluster"))
    last = F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0)).cast("int")
    cut = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    first = F.col("piece").cast("long") * capacity
    pieces = stored(cut.select("id", "row", "source", "cluster", "piece", first.alias("first_word"), F.least(F.col("n") - first, F.lit(capacity)).cast("int").alias("n_words")))
    pools = max(1, -(-pieces.count() // pool))
    dealt = pieces.withColumn("pool", F.pmod(F.xxhash64("row", "piece"), F.lit(pools)))
    out = dealt.groupBy("pool").applyInPandas(_filled(capacity), SCHEMA.format(id=docs.schema[id].dataType.simpleString()))
    return out.withColumnRenamed("id", id)


def _filled(capacity):
    def run(pdf):
        pdf = pdf.sort_values(["n_words", "row", "piece"], ascending=[False, True, True], kind="stable")
        sources = pd.factorize(pdf["source"])[0]  # -1: null
        shared = pdf["cluster"].duplicated(keep=False)
        clusters = pd.factorize(pdf["cluster"].where(shared))[0]  # -1: alone in its cluster
        bins, offsets = best_fit(pdf["n_words"].tolist(), sources.tolist(), clusters.tolist(), capacity)
        base = int(pdf["pool"].iloc[0]) << 32
        return pdf.assign(bin_id=[base + b for b in bins], bin_offset=offsets)[["id", "piece", "first_word", "n_words", "bin_id", "bin_offset"]]

    return run


def best_fit(sizes, sources, clusters, capacity):
    """The bin and the offset of each piece, placed in the order given; -1 stands for no source or no cluster."""
    residuals = []  # (what is left, bin), in order
    held = []  # by bin: bitmap of sources, bitmap of clusters
    bins, offsets = [], []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = (1 << source if source >= 0 else 0), (1 << cluster if cluster >= 0 else 0)
        at = bisect.bisect_left(residuals, (size, -1))
        while at < len(residuals) and (held[residuals[at][1]][0] & s or held[residuals[at][1]][1] & c):
            at += 1
        if at < len(residuals):
            left, b = residuals.pop(at)
            held[b] = held[b][0] | s, held[b][1] | c
        else:
            left, b = capacity, len(held)
            held.append((s, c))
        bins.append(b)
        offsets.append(capacity - left)
        bisect.insort(residuals, (left - size, b))
    return bins, offsets
