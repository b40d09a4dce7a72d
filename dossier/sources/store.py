"""The profile table: immutable parquet segments, named by a manifest and partitioned by a bucket of the id, a hash of the upsert key."""

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier import schema
from dossier.operators.upsert import latest_by_key, merge_latest
from dossier.sources.manifest import Manifest

KEEP = ["profile_id"]
REPLACE = ["parsed_data", "other_contacts", "skills_all", "skills_proficient"]

STORED = T.StructType(
    [
        T.StructField("profile_id", T.StringType()),
        T.StructField("email", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("parsed_data", schema.PARSED_DATA),
        T.StructField("other_contacts", T.MapType(T.StringType(), T.StringType())),
        T.StructField("skills_all", T.ArrayType(T.StringType())),
        T.StructField("skills_proficient", T.ArrayType(T.StringType())),
        T.StructField("bucket", T.IntegerType()),
    ]
)


def profile_key(email):
    """A 24-digit id that is the same again when a lost task or a batch is repeated."""
    return F.left(F.sha2(email, 256), F.lit(24))


def promote(df):
    """Adds the flattened skill lists that skill filters test instead of the six nested ones."""
    none = F.array().cast("array<string>")

    def union(*levels):
        lists = [F.coalesce(F.col(f"parsed_data.skills.{k}.{level}"), none) for k in schema.SKILL_KINDS for level in levels]
        return F.array_distinct(F.concat(*lists))

    return df.withColumns({"skills_all": union("proficient", "average"), "skills_proficient": union("proficient")})


def bucket_of(profile_id, buckets):
    """The bucket follows from the id, which follows from the e-mail, so either one names the place of a profile."""
    return F.pmod(F.conv(F.right(profile_id, F.lit(8)), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")


def with_bucket(df, buckets):
    return df.withColumn("bucket", bucket_of(F.col("profile_id"), buckets))


def dealt(df):
    """Rows with a ``bucket`` and a ``profile_id``, dealt and sorted as ``write_dealt`` writes them.

    The rebalance lets the adaptive planner cut large buckets into several files and keep small
    ones in one; sorted ids give the row groups of a file narrow id ranges.
    """
    return df.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "profile_id")


def write_dealt(df, path):
    """Writes rows that are ``dealt`` by bucket to a new folder, or to one that an unfinished try has left."""
    df.select(*[f.name for f in STORED]).write.mode("overwrite").partitionBy("bucket").parquet(path)


def write_buckets(df, path):
    """Writes rows by bucket. Where rows are made wide by a map, it is cheaper to deal them before it (``dealt``)."""
    write_dealt(dealt(df.select(*[f.name for f in STORED])), path)


def read_profiles(spark, path):
    return spark.read.schema(STORED).parquet(path)


class ProfileStore:
    """Profiles under ``path``.

    A batch is written as a segment of its own, in proportion to the batch, and published by one new
    manifest file that names all segments. What is published is never changed or overwritten: a
    driver lost before the manifest leaves a segment that nobody reads, one lost after it a batch
    that is known when it comes again. Readers take the segments of the manifest they began with and
    see of each e-mail the newest row by ``seq``. ``compact`` makes one segment of them from time to
    time, which keeps reading cheap; it deletes nothing, ``unreferenced`` lists what may go.

    One writer at a time; of two that publish the same version the second fails and may repeat.
    """

    def __init__(self, spark, path, buckets=64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.manifest = Manifest(spark, self.path)

    def create(self):
        """An empty table unless there is one."""
        if self._version() < 0:
            self._publish(0, {"segments": [], "batches": []})
        return self

    # --- manifest ---

    def _version(self):
        return self.manifest.version()

    def _manifest(self):
        return self.manifest.read()

    def _publish(self, version, content):
        self.manifest.publish(version, content)

    # --- reading ---

    def segments(self):
        """Folders of the published segments, oldest first."""
        return [f"{self.path}/data/{name}" for name in self._manifest()[1]["segments"]]

    def read(self, where=None):
        """One row per e-mail: the first segment less what newer ones replace, and the newest of those.

        Batches are small against the first segment, whose payload passes an anti join that the
        adaptive planner broadcasts while they are. ``where`` is a condition on ``profile_id``, ``email`` and ``bucket``; as
        these are the same in all versions of a profile, it is put to each segment before they meet.
        """
        paths = self.segments()
        if not paths:
            return self.spark.createDataFrame([], STORED)

        def segment(path):
            rows = read_profiles(self.spark, path)
            return rows if where is None else rows.where(where)

        base = segment(paths[0])
        if len(paths) == 1:
            return base
        parts = [segment(p).withColumn("_order", F.struct("seq", F.lit(i))) for i, p in enumerate(paths[1:])]
        newer = reduce(lambda a, b: a.unionByName(b), parts)
        # the winner of each e-mail is found from narrow columns, then its row is taken
        best = newer.groupBy("email").agg(F.max("_order").alias("_order"))
        latest = newer.join(best, ["email", "_order"], "left_semi").drop("_order", "bucket")
        merged = merge_latest(base.drop("bucket"), latest, "email", "seq", KEEP, REPLACE)
        return with_bucket(merged, self.buckets).select(*[f.name for f in STORED])

    def by_id(self, profile_id):
        """The profile of an id, from its bucket of each segment alone."""
        return self.read((F.col("bucket") == bucket_of(F.lit(profile_id), self.buckets)) & (F.col("profile_id") == profile_id))

    def by_email(self, email):
        """The profile of an e-mail, from its bucket alone."""
        return self.read((F.col("bucket") == bucket_of(profile_key(F.lit(email)), self.buckets)) & (F.col("email") == email))

    def by_ids(self, ids, key="profile_id"):
        """Profiles whose id is in the DataFrame ``ids``. What comes to the driver are the numbers of the buckets they lie in."""
        wanted = with_bucket(ids.select(F.col(key).alias("profile_id")).where("profile_id IS NOT NULL").distinct(), self.buckets)
        buckets = [r.bucket for r in wanted.select("bucket").distinct().where("bucket IS NOT NULL").collect()]
        found = self.read(F.col("bucket").isin(buckets)) if len(buckets) < self.buckets else self.read()
        return found.join(wanted, ["bucket", "profile_id"], "left_semi").select(*[f.name for f in STORED])

    # --- writing ---

    def upsert(self, batch, batch_id=None):
        """``batch``: email, seq, parsed_data, other_contacts. A ``batch_id`` that is known is not taken in again."""
        version, content = self._manifest()
        if batch_id is not None and str(batch_id) in content["batches"]:
            return
        new = promote(batch).withColumn("profile_id", profile_key(F.col("email")))
        latest = latest_by_key(new, "email", "seq", first=KEEP, last=["seq", *REPLACE])
        name = f"batch-{version + 1:012d}"
        write_buckets(with_bucket(latest, self.buckets), f"{self.path}/data/{name}")
        known = [] if batch_id is None else [str(batch_id)]
        # of a stream only the last batch can come again, a few more are kept for good measure; an older one would change
        # nothing either, as its rows are not newer by seq than what is stored
        self._publish(version + 1, {"segments": [*content["segments"], name], "batches": [*content["batches"], *known][-1000:]})

    def compact(self):
        """One segment of all of them; those that were read stay where they are."""
        version, content = self._manifest()
        name = f"base-{version + 1:012d}"
        write_buckets(self.read(), f"{self.path}/data/{name}")
        self._publish(version + 1, content | {"segments": [name]})

    def unreferenced(self):
        """Segment folders that the current manifest does not name; readers that began earlier may still use them."""
        return sorted(set(self.manifest.names(f"{self.path}/data")) - set(self._manifest()[1]["segments"]))
