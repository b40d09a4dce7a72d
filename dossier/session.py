"""Session helpers."""

import contextlib
import tempfile

from pyspark.sql import SparkSession

_own_folders = {}


def local_session(cores="*", shuffle_partitions=8, **conf):
    """A session for tests and the bench; on a cluster the submitter brings the session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("dossier")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark):
    """The folder every executor sees, as the cluster names it.

    Only a local session, which has one machine, may fall back to a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="dossier-")
    return _own_folders[app]


@contextlib.contextmanager
def shuffles_removed(spark):
    """Shuffle files of a job begun within are removed as soon as it has ended, not when the driver next collects garbage.

    For jobs that write what they make: nothing reads their shuffles again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)
