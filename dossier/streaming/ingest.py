"""Continuous ingestion: new document files to profiles, outcomes and tracking updates."""

from pyspark.sql import functions as F

from dossier.functions.text import blank_to_null, first_email, first_mobile
from dossier.operators.hotkeys import spread
from dossier.plans.etl import accepted, process, read_outcome, tracking_updates, write_outcome

DOCUMENT = "doc_id string, seq bigint, text string, urls array<string>, reply string"


def with_text_contacts(documents):
    """Contact details found in the text of each document.

    Lower case is enough: taking out stop words drops whole words, and no pattern spans white space.
    """
    lower = F.lower("text")
    found = {"has_text": blank_to_null(F.col("text")).isNotNull(), "text_email": first_email(lower), "text_mobile": first_mobile(lower)}
    return documents.withColumns(found).drop("text")


def apply_batch(documents, batch_id, store, outcome_path, updates_path, at=None):
    """One batch into the profile store, the outcome table and the tracking updates.

    ``documents`` are rows of ``DOCUMENT`` or come from ``etl.gather``.

    The outcome is written first and read back for the rest: replies are parsed once, and a lost
    executor costs its tasks only. Everything is written under the batch id or merged by sequence,
    so repeating a batch after a failure changes nothing.
    """
    staged = f"{outcome_path}/batch={batch_id}"
    ready = documents if "has_text" in documents.columns else with_text_contacts(documents)
    write_outcome(process(ready), staged)
    outcome = read_outcome(store.spark, staged)
    store.upsert(accepted(outcome), batch_id)
    now = F.current_timestamp() if at is None else F.lit(at).cast("timestamp")
    tracking_updates(outcome, now).write.mode("overwrite").parquet(f"{updates_path}/batch={batch_id}")


def ingest(spark, folder, store, outcome_path, updates_path, checkpoint, at=None, files_per_batch=1000, clean_source="off"):
    """Processes the files of ``folder`` not yet seen, then stops; restart it to go on.

    ``clean_source="delete"`` removes processed files.
    """
    stream = (
        spark.readStream.schema(DOCUMENT)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("cleanSource", clean_source)
        .parquet(folder)
    )

    def sink(batch, batch_id):
        # a batch may be a few large files, and parsing is dear
        apply_batch(spread(batch), batch_id, store, outcome_path, updates_path, at)

    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
