"""Tables in the folder that all executors share."""

import tempfile
import uuid

import numpy as np
from pyspark.sql import functions as F

#: Rows that a file may have: numbers of files are at least so far apart.
ROWS = 2**33


def stored(df):
    """Writes ``df`` into the shared folder and reads it back: its lineage ends there, so a lost executor costs
    no recomputation. The folder is ``spark.checkpoint.dir``; a local session without it uses one of its own."""
    spark = df.sparkSession
    path = f"{folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def freed(df):
    """``stored``, and the shuffle files of the job are removed as soon as the table is written, not when the driver next collects garbage."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        return stored(df)
    finally:
        spark.conf.set(key, before)


def dropped(*tables):
    """Removes tables of ``stored`` that nothing reads any more."""
    for table in tables:
        for path in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            spark = table.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def numbered(df, name="__row"):
    """``df`` with a unique long for each row that is the same whenever, and on however many cores, the result is read.

    The number of a row is that of its file plus its place in the file. Numbers of files are hashes of their paths, under
    the first seed that keeps any two of them ``ROWS`` apart; there are as many as files, whose list the driver holds
    anyway. Anything but a plain scan of Parquet files is stored first.
    """
    if not _scan(df):
        df = stored(df)
    place = df.metadataColumn("_metadata")
    paths = df.select(place["file_path"].alias("path")).distinct()
    for seed in range(100):
        base = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "path"), 2)
        known = np.sort(np.array([r[0] for r in paths.select(base).collect()], np.int64))
        if (np.diff(known) >= ROWS).all():
            break
    else:
        raise ValueError("too many files to number their rows apart")
    of_file = F.shiftrightunsigned(F.xxhash64(F.lit(seed), place["file_path"]), 2)
    return df.select((of_file + place["row_index"]).alias(name), *(F.col(f"`{c}`") for c in df.columns))


def _scan(df):
    """Whether ``df`` is columns and rows of a table of Parquet files, each file's rows once."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.child()
    return plan.nodeName() == "LogicalRelation" and plan.toString().strip().lower().endswith(" parquet")


def by_place(df):
    """``df`` with its columns named by their places, so that none clashes with what an operator adds, and the new names by the old."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def named(df, names, *added):
    """The columns of ``by_place`` under their old names, without those that ``added`` replaces (in any letter case), then ``added``."""
    new = {c.lower() for c in added}
    return df.select(*(F.col(c).alias(old) for old, c in names.items() if old.lower() not in new), *added)


def folder(spark):
    """The folder that all executors share, as the session names it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="dossier-llm-"))
    return spark.sparkContext.getCheckpointDir()


def write_bytes(spark, path, content):
    """Writes one file into the shared folder."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, False)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
