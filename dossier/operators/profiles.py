"""Replies to typed profiles, with the reasons against those that break a rule."""

from functools import lru_cache

from pyspark.sql import functions as F

from dossier import schema
from dossier.functions import conform as C
from dossier.functions import jsontext as J


def unwrap_replies(df, reply="reply"):
    """Adds ``content``: the message text without code fences, NULL when there is none."""
    return df.withColumn("content", J.without_fences(J.reply_content(F.col(reply))))


def parse_content(df, content="content"):
    """Adds ``json_text`` (the text that parsed), ``document`` (VARIANT) and ``repaired``.

    Repair is tried only on the rows whose first parse failed. Of equal keys of an object the last one
    counts; the parser of Spark has to be told so for the session.
    """
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return (
        df.withColumn("_box", J.boxed(F.col(content)))
        .withColumn("_first", J.unboxed(F.col("_box")))
        .withColumn("_fixed", F.when(F.col("_first").isNull(), J.repaired(F.col(content))))
        .withColumn("_box", J.boxed(F.col("_fixed")))
        .withColumn("document", F.coalesce("_first", J.unboxed(F.col("_box"))))
        .withColumn("repaired", F.col("_first").isNull() & F.col("document").isNotNull())
        .withColumn("json_text", F.when(F.col("document").isNotNull(), F.coalesce("_fixed", content)))
        .drop("_box", "_first", "_fixed")
    )


def conform(df, document="document", json_text="json_text"):
    """Adds ``parsed_data``, ``other_contacts`` and ``errors`` from a parsed document."""
    app = df.sparkSession.sparkContext.applicationId
    parsed_data, other_contacts, errors = _profile_columns(app)
    named = df.withColumns(
        {"_document": F.col(document), "_text": F.col(json_text), "_opened": C.opened(F.col(document), schema.PROFILE)}
    )
    checked = named.withColumns({"parsed_data": parsed_data, "other_contacts": other_contacts, "errors": errors})
    return checked.drop("_document", "_text", "_opened")


@lru_cache(maxsize=1)
def _profile_columns(app):
    """The generated expressions; there are thousands, so an application builds them once."""
    top = F.col("_opened")
    fields = []
    for f in schema.PROFILE:
        value = C.typed(top[f.name], f)
        fields.append((_skills(value) if f.name == "skills" else value).alias(f.name))
    errors = (
        F.when(F.col("_document").isNull(), F.array(F.lit("syntax:$")))
        .when(top.isNull(), F.array(F.lit("type:$")))
        .otherwise(C.profile_problems(top, schema.PROFILE))
    )
    parsed_data = F.when(top.isNotNull(), F.struct(*fields))
    return parsed_data, C.other_keys(top["personal_information"], schema.PERSONAL_KEYS), errors


def _skills(value):
    """Skills with the experience entries in reply order beside the map; the value is computed once for all its fields."""

    def joined(skills):
        parts = []
        for f in schema.PARSED_DATA["skills"].dataType:
            ordered = f.name == "skill_entries"
            parts.append((C.ordered_years(F.col("_text")) if ordered else skills[f.name]).alias(f.name))
        return F.when(skills.isNotNull(), F.struct(*parts))

    return C.once(value, joined)
