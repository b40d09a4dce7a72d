"""The tracking table: intake and logs as appended segments, folded into one row a document when they are read."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier import schema
from dossier.operators.tracking import folded, intake
from dossier.sources.manifest import Manifest

#: Rows with the sequence of the last update in them, so that an older one that comes later changes nothing.
ROWS = T.StructType([*schema.TRACKING, T.StructField("seq", T.LongType())])
LOG = "id string, seq bigint, parsing_status string, resume_category string, parsed_data_id string, at timestamp, failed_tries int, closed boolean"


class TrackingStore:
    """Tracking rows under ``path``.

    An upload adds its rows and a batch its log, as a segment in proportion to it; one new manifest file publishes the
    segment together with the number of the batch, so a batch counts once however often it is repeated: what was lost
    before that file was never there, and what comes again after it is known. Of each source of batches (a stream
    numbers them in order) the last number is kept, nothing grows with the batches. ``compact`` folds the logs into
    the rows from time to time. One writer at a time.
    """

    def __init__(self, spark, path):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest = Manifest(spark, self.path)

    def _state(self):
        if self.manifest.version() < 0:
            return -1, {"rows": [], "logs": [], "applied": {}}
        return self.manifest.read()

    def _read(self, names, shape):
        if not names:
            return self.spark.createDataFrame([], shape)
        return self.spark.read.schema(shape).parquet(*[f"{self.path}/data/{n}" for n in names])

    def _write(self, df, kind):
        name = f"{kind}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/data/{name}")
        return name

    def _publish(self, version, state):
        self.manifest.publish(version, state)

    def _folded(self, state):
        return folded(self._read(state["rows"], ROWS), self._read(state["logs"], LOG))

    def read(self):
        """One row per document, all published logs applied."""
        return self._folded(self._state()[1]).drop("seq")

    def add(self, files, at, file="file"):
        """Takes in a batch of files; returns their tracking rows. The same batch again changes nothing."""
        rows = intake(files, at, file)
        version, state = self._state()
        # only ids are read of what is there
        new = rows.join(self._read(state["rows"], ROWS).select("id"), "id", "left_anti").select(rows.columns)
        name = self._write(new.withColumn("seq", F.lit(None).cast("bigint")), "rows")
        self._publish(version + 1, state | {"rows": [*state["rows"], name]})
        return rows

    def settle(self, log, source="by hand", number=None):
        """Appends a log of ``etl.tracking_updates``: what was completed, tried again or, by a true ``closed``, given up.

        ``source`` and ``number`` name the batch; one whose number is not above the last of its source is known and not
        applied again. Without a number the log counts each time.
        """
        version, state = self._state()
        if number is not None and number <= state["applied"].get(source, -1):
            return
        shape = T._parse_datatype_string(LOG)
        log = log if "closed" in log.columns else log.withColumn("closed", F.lit(False))
        name = self._write(log.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in shape]), "log")
        applied = state["applied"] if number is None else state["applied"] | {source: number}
        self._publish(version + 1, state | {"logs": [*state["logs"], name], "applied": applied})

    def compact(self):
        """One segment of rows with all logs in them. Entries for documents that are not taken in yet stay as a log."""
        version, state = self._state()
        rows, logs = self._read(state["rows"], ROWS), self._read(state["logs"], LOG)
        early = self._write(logs.join(rows.select("id"), "id", "left_anti"), "log")
        name = self._write(self._folded(state), "rows")
        self._publish(version + 1, state | {"rows": [name], "logs": [early]})

    def unreferenced(self):
        """Segments that the current manifest does not name; readers that began earlier may still use them."""
        state = self._state()[1]
        return sorted(set(self.manifest.names(f"{self.path}/data")) - {*state["rows"], *state["logs"]})


def keyed_log(log, rows, file="file"):
    """A log by document name as a log by tracking id; ``rows``: the tracking rows of the upload."""
    ids = rows.select(F.col(file).alias("_file"), F.col("id").alias("_id"))
    return log.join(ids, F.col("id") == F.col("_file")).drop("id", "_file").withColumnRenamed("_id", "id")
