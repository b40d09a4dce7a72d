"""Documents and replies to accepted profiles and quarantined documents."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier import constants as K
from dossier import schema
from dossier.operators.contacts import contact_gate, document_links, merge_contacts, profile_links
from dossier.operators.pages import contacts_in_pages
from dossier.operators.profiles import conform, parse_content, unwrap_replies
from dossier.sources.store import profile_key

OUTCOME = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("errors", T.ArrayType(T.StringType())),
        T.StructField("parsed_data", schema.PARSED_DATA),
        T.StructField("other_contacts", T.MapType(T.StringType(), T.StringType())),
        T.StructField("error_class", T.StringType()),
    ]
)


def gather(pages, web_pages, replies, doc="doc_id", page="page"):
    """Documents for ``process`` from what their parts hold.

    ``pages``: doc, page, text; ``web_pages``: doc, page, html; ``replies``: doc, seq, reply, one row a
    document. Contacts and links are found where the pages are read; what is shuffled are a few short
    strings a page, and a document without pages has no text.
    """
    contacts = contacts_in_pages(pages, doc, page)
    return replies.join(contacts, doc, "left").join(document_links(web_pages, doc, page), doc, "left")


def process(documents):
    """``doc_id``, ``seq``, ``has_text``, ``text_email``, ``text_mobile``, ``reply`` and either ``urls`` or the
    profile links (``linkedin_url``, ``github_url``, ``mailto``) to one outcome per document.

    ``error_class`` names the step that failed, 'none' for an accepted profile, and ``errors`` the
    reasons. A failing document never stops the others, and there is no shuffle.
    """
    df = conform(parse_content(unwrap_replies(documents)))
    df = contact_gate(merge_contacts(profile_links(df) if "urls" in df.columns else df))
    no_text = ~F.coalesce("has_text", F.lit(False))
    broken = F.size("errors") > 0
    error_class = (
        F.when(no_text, K.EXTRACTION)
        .when(broken, K.PARSING)
        .when(F.col("gate_error").isNotNull(), K.SAVING)
        .otherwise(K.NO_ERROR)
    )
    errors = (
        F.when(no_text, F.array(F.lit("no_text")))
        .when(broken, F.col("errors"))
        .when(F.col("gate_error").isNotNull(), F.array("gate_error"))
        .otherwise(F.array().cast("array<string>"))
    )
    return df.select("doc_id", "seq", error_class.alias("error_class"), errors.alias("errors"), "parsed_data", "other_contacts")


def write_outcome(outcome, path):
    """Writes outcomes by error class, replacing what an earlier try left under ``path``.

    Each sink then reads the class it wants. Filtering ``outcome`` itself instead would parse every
    reply again for each sink, as the filter is pushed below the parsing with copies of it.
    """
    outcome.write.mode("overwrite").partitionBy("error_class").parquet(path)


def read_outcome(spark, path):
    return spark.read.schema(OUTCOME).parquet(path)


def accepted(outcome):
    """Rows to upsert, keyed by the final e-mail; ``outcome`` as read back."""
    email = F.col("parsed_data.personal_information.email").alias("email")
    return outcome.where(F.col("error_class") == K.NO_ERROR).select("doc_id", email, "seq", "parsed_data", "other_contacts")


def quarantined(outcome):
    """Documents that failed, with the class and the reasons; ``outcome`` as read back."""
    return outcome.where(F.col("error_class") != K.NO_ERROR).select("doc_id", "seq", "error_class", "errors")


def tracking_updates(outcome, at):
    """Log of one batch for ``tracking.settle``: an update for each accepted document, a failed try for each other.

    The id of a profile is a function of its e-mail, so nothing is looked up.
    """
    done = F.col("error_class") == K.NO_ERROR
    return outcome.select(
        F.col("doc_id").alias("id"),
        "seq",
        F.when(done, K.COMPLETED).alias("parsing_status"),
        F.when(done, F.col("parsed_data.resume_type")).alias("resume_category"),
        F.when(done, profile_key(F.col("parsed_data.personal_information.email"))).alias("parsed_data_id"),
        at.alias("at"),
        (~done).cast("int").alias("failed_tries"),
    )
