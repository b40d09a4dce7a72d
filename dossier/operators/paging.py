"""Stable pages."""

import math
import os

from pyspark.sql import functions as F

from dossier import constants as K

RANGE = 10 * K.MAX_PAGE_SIZE  # rows of a range that are ordered to find a page
STEP = 2  # characters by which a prefix grows
LONGEST = 256  # characters in which unique keys have to differ


def page_size(limit=None):
    """The asked size within 1..1000, 100 when it is no such number."""
    try:
        size = int(limit)
    except (TypeError, ValueError):
        return K.PAGE_SIZE
    return min(size, K.MAX_PAGE_SIZE) if size > 0 else K.PAGE_SIZE


def page(df, number=1, limit=None, key="profile_id"):
    """A 1-based page in the order of the unique text ``key``; "last" is the last one.

    Jobs over the keys of the matching rows find the page: counts by a prefix of the key tell in
    which range it begins, longer prefixes are counted inside a range of more than ``RANGE`` rows,
    and only what lies behind the beginning of the range is ordered, as far as the page goes. So no
    task ever keeps more than ``RANGE`` keys and a page, at any depth. The matching keys are kept while
    that goes on, so the filter runs once for all of it. Then the page is read between its first and
    last key: both are pushed to the scan, so of the wide columns only the row groups and column pages
    around them are decoded.
    """
    size = page_size(limit)
    if number != "last" and int(number) < 1:
        raise ValueError("page: invalid page")
    keys = df.select(F.col(key).alias("key")).persist()
    try:
        low, high, total = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
        number = max(1, math.ceil(total / size)) if number == "last" else int(number)
        skip = (number - 1) * size
        if skip >= total:
            return df.limit(0)
        start, skip = _range(keys, low, len(os.path.commonprefix([low, high])), total, skip)
        shown = keys.where(F.col("key") >= start).orderBy("key").offset(skip).limit(size)
        first, last = shown.agg(F.min("key"), F.max("key")).first()
    finally:
        keys.unpersist()
    return df.where(F.col(key).between(first, last)).orderBy(key).limit(size)


def _range(keys, start, known, rows, skip):
    """The start of the range that holds the row number ``skip``, and that row's number in it."""
    while rows > RANGE and known < LONGEST:
        known += STEP
        counts = keys.groupBy(F.left("key", F.lit(known)).alias("head")).count().orderBy("head").collect()
        for head, n in counts:  # as many as there are digits in the step
            if skip < n:
                start, rows = head, n
                break
            skip -= n
        keys = keys.where(F.startswith("key", F.lit(start)))
    return start, skip


def page_after(df, last_key=None, limit=None, key="profile_id"):
    """The page behind the last key seen: a pushed-down comparison and a top-k, at any depth."""
    rest = df if last_key is None else df.where(F.col(key) > last_key)
    return rest.orderBy(key).limit(page_size(limit))


def envelope(df, number=1, limit=None):
    """Count of all matching rows and the neighbouring page numbers, in one row."""
    size, number = page_size(limit), int(number)
    count = F.col("count")
    return df.agg(F.count("*").alias("count")).select(
        "count",
        F.when(count > number * size, number + 1).alias("next_page"),
        F.when((count > 0) & F.lit(number > 1), number - 1).alias("previous_page"),
    )
