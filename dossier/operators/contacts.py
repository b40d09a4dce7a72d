"""Contact details: precedence of their sources and the gate before saving."""

from pyspark.sql import functions as F

from dossier import schema
from dossier.functions.links import github_profile, link_targets, linkedin_profile, mail_address
from dossier.functions.text import repair_mobile

PERSONAL = "parsed_data.personal_information"


def profile_links(df, urls="urls"):
    """Adds the profile links of a link list; the last match of each kind wins."""
    links = F.col(urls)
    return df.withColumns(
        {"linkedin_url": linkedin_profile(links), "github_url": github_profile(links), "mailto": mail_address(links)}
    )


def document_links(pages, doc, page, html="html"):
    """Profile links of documents with many pages: of each kind the last match on the last page that has one.

    Each page is searched where it is read; only three short strings per page are aggregated.
    """
    found = profile_links(pages.select(doc, page, link_targets(F.col(html)).alias("urls")))
    kinds = ("linkedin_url", "github_url", "mailto")
    last = [F.expr(f"max_by({k}, {page}) FILTER (WHERE {k} IS NOT NULL)").alias(k) for k in kinds]
    return found.groupBy(doc).agg(*last)


def merge_contacts(df):
    """Links before text before the parsed profile; only a parsed mobile needs repair.

    Reads ``linkedin_url``, ``github_url``, ``mailto``, ``text_email`` and ``text_mobile``.
    """
    own = F.col(PERSONAL)
    best = {
        "email": F.coalesce("mailto", "text_email", own["email"]),
        "mobile": F.coalesce("text_mobile", repair_mobile(own["mobile"])),
        "linkedin": F.coalesce("linkedin_url", own["linkedin"]),
        "github": F.coalesce("github_url", own["github"]),
    }
    merged = F.struct(*[best.get(k, own[k]).alias(k) for k in schema.PERSONAL_KEYS])
    return df.withColumn(
        "parsed_data", F.col("parsed_data").withField("personal_information", F.when(own.isNotNull(), merged))
    )


def contact_gate(df):
    """Adds ``gate_error``: what keeps the profile from being saved, NULL when nothing does.

    A badly shaped e-mail passes; only its absence counts.
    """
    own = F.col(PERSONAL)
    return df.withColumn(
        "gate_error",
        F.when(own.isNull(), "contacts_missing")
        .when(F.coalesce(own["email"], F.lit("")) == "", "email_missing")
        .when(own["mobile"].isNull(), "mobile_missing"),
    )
