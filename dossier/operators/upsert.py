"""Upsert by key without MERGE."""

from pyspark.sql import functions as F


def latest_by_key(batch, key, seq, first, last):
    """One row per key: columns ``first`` from its earliest row, columns ``last`` from its latest.

    Rows without a key are left out (the gate has sent them to quarantine). ``seq`` must be a total
    order within a key. Both sides of the shuffle aggregate, so repeated keys are reduced before it.
    """
    early = F.min_by(F.struct(*first), seq).alias("_first")
    late = F.max_by(F.struct(*last), seq).alias("_last")
    grouped = batch.where(F.col(key).isNotNull()).groupBy(key).agg(early, late)
    return grouped.select(key, *[F.col(f"_first.{c}") for c in first], *[F.col(f"_last.{c}") for c in last])


def merge_latest(stored, latest, key, seq, keep, replace):
    """Stored rows and the latest of a batch as the new content.

    A known key keeps its columns ``keep`` and takes the columns ``replace`` unless the stored ones
    are newer by ``seq``, so that a replayed batch changes nothing. Both sides hold a key once.

    Only keys, ids and sequences of the stored rows meet the batch; their payload passes an anti
    join, which needs no shuffle when the batch is small against the store.
    """
    columns = [key, *keep, seq, *replace]
    known = stored.select(key, F.col(seq).alias("_seq"), *[F.col(c).alias(f"_{c}") for c in keep])
    winners = (
        latest.join(known, key, "left")
        .where(F.col("_seq").isNull() | (F.col(seq) >= F.col("_seq")))
        .select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in keep], seq, *replace)
    )
    rest = stored.join(winners.select(key), key, "left_anti")
    return rest.select(*columns).unionByName(winners)
