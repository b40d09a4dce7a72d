"""Reading of text documents and writing of results."""

from pyspark.sql import functions as F

from dossier.operators.export import json_documents


def read_documents(spark, path):
    """One row per text file: ``file`` and its whole ``text``."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def write_csv(df, path, mode="errorifexists", rows=5_000, compression="none"):
    """Flat columns as CSV with a header per file, quotes doubled, nothing written for ''.

    A value may hold line feeds, so a file is read by one task: files have at most ``rows`` rows. For the same reason
    nothing is lost by a ``compression`` that cannot be split, such as gzip; ``read_csv`` knows it by the files' names.
    """
    df.write.mode(mode).option("maxRecordsPerFile", rows).csv(path, header=True, escape='"', emptyValue="", nullValue="", compression=compression)


def read_csv(spark, path):
    return spark.read.csv(path, header=True, escape='"', multiLine=True, nullValue="", emptyValue="").na.fill("")


def write_json(profiles, path, mode="errorifexists"):
    """Whole profiles as JSON lines, null fields kept."""
    json_documents(profiles).write.mode(mode).text(path)
