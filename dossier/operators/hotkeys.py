"""Joins and maps that stay even: when one key holds a large share of the rows, or a few files hold all of them."""

from pyspark.sql import functions as F

SHARE = 200  # a key is hot when it holds more than 1/SHARE of the rows, so there are fewer than SHARE
SLICES = 64
ROWS = 250_000  # of a table that a task sums by key


def hot_keys(many, key, share=SHARE):
    """Keys holding more than 1/share of the rows: fewer than ``share`` of them, whatever the data."""
    counts = many.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    bound = counts.agg((F.sum("_n") / share).alias("_bound")).scalar()
    return counts.where(F.col("_n") > bound).select(key, F.lit(True).alias("_hot"))


def lookup_join(many, one, key, spread, share=SHARE, slices=SLICES):
    """``many`` left-joined to ``one``, which holds each key at most once.

    Rows of hot keys, and rows without a key, are spread over ``slices`` by the column ``spread``;
    only the few hot rows of ``one`` are repeated for that.
    """
    hot = hot_keys(many, key, share)
    slot = F.pmod(F.xxhash64(spread), F.lit(slices)).cast("int")
    left = many.join(F.broadcast(hot), key, "left").withColumn(
        "_slot", F.when(F.col("_hot") | F.col(key).isNull(), slot).otherwise(F.lit(0))
    )
    slots = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(slices - 1))).otherwise(F.array(F.lit(0)))
    right = one.join(F.broadcast(hot), key, "left").withColumn("_slot", F.explode(slots)).drop("_hot")
    return left.drop("_hot").join(right, [key, "_slot"], "left").drop("_slot")


def spread(df, *by):
    """``df`` dealt evenly, or by the columns ``by``, before a map whose cost is in its rows, not in their bytes, so that all cores take part.

    Partitions of a scan follow the bytes and row groups of its files: a small file with many rows, each of which becomes
    a document to be parsed, would be one task. The number is given, so the adaptive planner does not put them together again.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *by)


def tasks_for(df, rows=ROWS):
    """Partitions for sums over the rows of a stored table: in proportion to the rows, which Parquet counts without reading them.

    A sum by many keys holds them in memory, and what a scan or the adaptive planner gives one task follows from bytes, which are few.
    """
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))
