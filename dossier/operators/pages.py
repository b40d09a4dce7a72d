"""Document text from pages and from a second reader."""

from pyspark.sql import functions as F

from dossier.functions.text import blank_to_null, first_email, first_mobile, strip


def assemble_pages(pages, doc, page, text="text"):
    """One row per document: its page texts in page order, joined by line feeds.

    Empty pages leave no line; white space is taken off the two ends of the document only. The
    layout is the same for every size, so a document is bounded by what one text value holds (2 GB);
    what is looked for in text is found page by page (``contacts_in_pages``) and needs no long text.
    """
    filled = F.when(F.col(text) != "", F.struct(F.col(page).alias("page"), F.col(text).alias("text")))
    ordered = F.array_sort(F.collect_list(filled))
    grouped = pages.groupBy(doc).agg(ordered.alias("_pages"))
    return grouped.select(doc, strip(F.array_join(F.col("_pages.text"), "\n")).alias("text"))


def fill_blank_documents(primary, fallback, doc):
    """Rows of ``primary`` (``doc``, ``text``); a blank text there is taken from ``fallback``.

    A document that is blank in both keeps its row with NULL text. Only the blank ones are joined.
    """
    text = blank_to_null(F.col("text"))
    own = primary.select(doc, text.alias("text"))
    second = fallback.select(doc, text.alias("text"))
    return own.where("text IS NOT NULL").unionByName(own.where("text IS NULL").select(doc).join(second, doc, "left"))


def contacts_in_pages(pages, doc, page, text="text"):
    """First e-mail and first mobile of each document, and whether it has any text.

    The patterns do not span white space, so each page is searched where it is read, and the first
    finds in page order are two short strings of a partial aggregate. Of pages with one number the
    text that sorts first counts, as in the assembled document.
    """
    lower = F.lower(text)
    found = pages.select(
        doc,
        F.col(page).alias("_page"),
        F.col(text).alias("_text"),
        first_email(lower).alias("email"),
        first_mobile(lower).alias("mobile"),
        blank_to_null(F.col(text)).isNotNull().alias("has"),
    )

    def first(name):
        place = f"CASE WHEN {name} IS NOT NULL THEN struct(_page, _text) END"
        return F.expr(f"min_by({name}, {place}) FILTER (WHERE {name} IS NOT NULL)").alias(f"text_{name}")

    return found.groupBy(doc).agg(first("email"), first("mobile"), F.coalesce(F.bool_or("has"), F.lit(False)).alias("has_text"))
