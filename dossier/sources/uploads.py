"""A folder of uploaded files: intake into the tracking table, and their removal once they are settled."""

import itertools
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from dossier import constants as K
from dossier import schema
from dossier.operators.hotkeys import spread

LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
AT_ONCE, NAMES = 32, 1000  # calls to the file system at a time, and names in the driver


def listed(spark, folder):
    """Files below a folder with size and time of change; what is in them is not read.

    Folders are listed by a few tasks a core; by Spark's own setting each would be a task, which takes longer to start than to list.
    """
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(4 * spark.sparkContext.defaultParallelism))
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    finally:
        spark.conf.set(LISTING, before)
    return files.select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("changed_at"))


def take_in(spark, folder, tracking, at):
    """Tracking rows of the files that are not tracked yet; none if all are. Uploading goes on meanwhile, so call it again and again."""
    new = listed(spark, folder).join(tracking.read().select("file"), "file", "left_anti")
    if new.isEmpty():
        return spark.createDataFrame([], schema.TRACKING)
    return tracking.add(new.select("file"), at)


def clean_up(spark, folder, tracking, archive=None):
    """Removes the files of completed documents, or moves them below ``archive``; returns how many.

    Files of failed documents stay, as does what is not tracked. Only files that are still there are gone through, ``NAMES``
    at a time and ``AT_ONCE`` at once, as Spark's own cleaner of stream sources does; a file that is gone is passed over, so
    a clean-up that was interrupted may be repeated.
    """
    done = tracking.read().where(F.col("parsing_status") == K.COMPLETED).select(F.col("storage_path").alias("file"))
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    top = files.makeQualified(root).toString().rstrip("/")

    def away(name):
        path = hadoop.Path(name)
        if archive is None:
            return files.delete(path, False)
        target = hadoop.Path(archive.rstrip("/") + path.toString()[len(top) :])
        files.mkdirs(target.getParent())
        return files.rename(path, target)

    names = (row.file for row in spread(listed(spark, folder).join(done, "file", "left_semi").select("file")).toLocalIterator())
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return sum(sum(pool.map(away, some)) for some in itertools.batched(names, NAMES))
