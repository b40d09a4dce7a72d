"""The tracking table: intake, updates, retries, lookups and roll-ups."""

from pyspark.sql import functions as F

from dossier import constants as K
from dossier import schema
from dossier.operators.hotkeys import lookup_join

UPDATABLE = ("storage_path", "parsing_status", "no_of_retries", "parsed_data_id", "resume_category")


def content_id(*cols):
    """UUID-shaped id of some text columns, the same again when a lost task is repeated."""
    digest = F.sha2(F.concat_ws("|", *cols), 256)
    return F.regexp_replace(F.left(digest, F.lit(32)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def intake(files, at, file="file"):
    """Tracking rows of a batch of files, one row and one id each; an empty batch is an error.

    An id is a function of the name, of the moment (as microseconds, so of no time zone) and of how
    many times the name came before in the batch; names are numbered within their own group only.
    """
    if files.isEmpty():
        raise ValueError("no files")
    at = at if not isinstance(at, str) else F.lit(at).cast("timestamp")
    copies = files.groupBy(file).agg(F.count("*").alias("_n"))
    files = copies.select(file, F.explode(F.sequence(F.lit(1).cast("bigint"), "_n")).alias("_copy"))
    values = {
        "id": content_id(F.col(file), F.unix_micros(at).cast("string"), F.col("_copy").cast("string")),
        "file": F.col(file),
        "storage_path": F.col(file),
        "parsing_status": F.lit(K.IN_PROGRESS),
        "no_of_retries": F.lit(0),
        "parsed_data_id": F.lit(""),
        "resume_category": F.lit(""),
        "created_at": at,
        "modified_at": at,
    }
    return files.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in schema.TRACKING])


def by_id(df, value, key="id"):
    return df.where(F.col(key) == value)


def by_ids(df, ids, key="id"):
    """Rows whose key is in the DataFrame ``ids``; repeated ids are reduced before the join."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def modified_since(tracking, since):
    """Profile ids of the rows modified at or after ``since``; malformed ids are skipped."""
    recent = tracking.where(F.col("modified_at") >= since)
    valid = recent.where(F.col("parsed_data_id").rlike(K.OBJECT_ID))
    return valid.select(F.lower("parsed_data_id").alias("profile_id")).distinct()


def apply_updates(tracking, updates, seq="seq", at="at"):
    """Tracking after a log of updates (``id``, ``seq``, ``at`` and some of UPDATABLE).

    Only given (non-NULL) values overwrite; the last one by ``seq`` counts. The log is reduced to
    one row per id before the join, however many updates one id has.
    """
    given = [c for c in UPDATABLE if c in updates.columns]
    any_given = F.coalesce(*[F.col(c).cast("string") for c in given]).isNotNull()
    last = [F.expr(f"max_by({c}, {seq}) FILTER (WHERE {c} IS NOT NULL)").alias(f"_{c}") for c in given]
    reduced = (
        updates.where(any_given).groupBy("id").agg(*last, F.max(at).alias("_at"))
    )
    joined = tracking.join(reduced, "id", "left")
    new = {c: F.coalesce(f"_{c}", c) for c in given} | {"modified_at": F.coalesce("_at", "modified_at")}
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in tracking.columns])


def settle(tracking, log):
    """Tracking after a log of ``etl.tracking_updates``: updates, then failed tries, then final failures."""
    tried = log.groupBy("id").agg(F.sum("failed_tries").cast("int").alias("_n")).where("_n > 0")
    updated = apply_updates(tracking, log.where("failed_tries = 0"))
    total = F.col("no_of_retries") + F.coalesce("_n", F.lit(0))
    return mark_failed(updated.join(tried, "id", "left").withColumn("no_of_retries", total).drop("_n"))


def folded(rows, log):
    """Tracking rows (with ``seq``, that of the last update in them) after a log of any number of batches.

    The log is reduced to one row per id, on the map side first; updates (which give all three columns) older than what a
    row holds are passed over, failed tries added up, and what is closed without being completed has failed. Folding in
    parts, in any order, gives the same rows.
    """
    done = F.col("failed_tries") == 0
    given = ("parsing_status", "resume_category", "parsed_data_id")
    last = [F.expr(f"max_by({c}, seq) FILTER (WHERE failed_tries = 0 AND {c} IS NOT NULL)").alias(f"_{c}") for c in given]
    one = log.groupBy("id").agg(
        *last,
        F.max(F.when(done, F.col("seq"))).alias("_seq"),
        F.max(F.when(done, F.col("at"))).alias("_at"),
        F.sum("failed_tries").cast("int").alias("_tries"),
        F.bool_or("closed").alias("_closed"),
    )
    newer = F.col("_seq") >= F.coalesce("seq", F.col("_seq"))
    new = {c: F.when(newer, F.coalesce(f"_{c}", c)).otherwise(F.col(c)) for c in given}
    new["modified_at"] = F.when(newer, F.greatest("_at", "modified_at")).otherwise(F.col("modified_at"))
    new["seq"] = F.greatest("_seq", "seq")
    new["no_of_retries"] = F.col("no_of_retries") + F.coalesce("_tries", F.lit(0))
    joined = rows.join(one, "id", "left")
    marked = mark_failed(joined.select(*[new.get(c, F.col(c)).alias(c) for c in rows.columns], "_closed"))
    given_up = F.col("_closed") & (F.col("parsing_status") == K.IN_PROGRESS)
    return marked.withColumn("parsing_status", F.when(given_up, K.FAILED).otherwise(F.col("parsing_status"))).drop("_closed")


def count_retries(tracking, retries):
    """``no_of_retries`` plus the rows of the retry log (``id``)."""
    counted = retries.groupBy("id").agg(F.count("*").cast("int").alias("_n"))
    total = F.col("no_of_retries") + F.coalesce("_n", F.lit(0))
    return tracking.join(counted, "id", "left").withColumn("no_of_retries", total).drop("_n")


def mark_failed(tracking):
    """Rows that used up their retries without being completed are failed."""
    spent = (F.col("no_of_retries") >= K.MAX_RETRIES) & (F.col("parsing_status") == K.IN_PROGRESS)
    return tracking.withColumn("parsing_status", F.when(spent, K.FAILED).otherwise(F.col("parsing_status")))


def link_profiles(uploads, profiles, email="email"):
    """Uploads with the id of their profile; many uploads may share one profile."""
    ids = profiles.select(email, F.col("profile_id").alias("parsed_data_id"))
    return lookup_join(uploads, ids, email, spread="id")


def distinct_categories(tracking):
    return tracking.select("resume_category").distinct()


def status_rollup(tracking):
    """Rows, retried rows and retries per status."""
    return tracking.groupBy("parsing_status").agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("no_of_retries") > 0).alias("retried"),
        F.sum("no_of_retries").alias("retries"),
    )
