"""Text clean-up and contact details found in text."""

from functools import reduce

from pyspark.sql import functions as F

from dossier import constants as K


def strip(col):
    """Trim all Unicode white space from both ends (``trim`` alone takes spaces only)."""
    return F.btrim(col, F.lit(K.WHITESPACE))


def blank_to_null(col):
    """Stripped text, NULL when nothing is left."""
    return F.nullif(strip(col), F.lit(""))


def drop_stop_words(col):
    """Words that are not stop words, joined by single spaces; a word with punctuation stays."""
    words = F.regexp_extract_all(col, F.lit(K.WORD), F.lit(0))
    return F.array_join(F.filter(words, lambda w: ~w.isin(K.STOP_WORDS)), " ")


def clean(col):
    return drop_stop_words(F.lower(col))


def first_email(col):
    """First match of the e-mail pattern.

    A match begins where a run of its characters begins, so starting nowhere else is the same and
    keeps the search linear in long unbroken text; text without @ is not searched at all.
    """
    anchored = r"(?<![a-zA-Z0-9._%+-])" + K.EMAIL
    return F.when(F.contains(col, F.lit("@")), F.nullif(F.regexp_extract(col, anchored, 0), F.lit("")))


def first_mobile(col):
    """Ten digits from 6-9 on; the left side is open, so the tail of a longer number counts."""
    return F.nullif(F.regexp_extract(col, K.MOBILE, 2), F.lit(""))


def repair_mobile(col):
    """Country code if present plus the first ten digits, NULL when they make no number."""
    code = F.lit(K.COUNTRY_CODE)
    digits = F.regexp_replace(F.replace(col, code, F.lit("")), r"(?U)\D", "")
    usable = (F.length(digits) >= 10) & digits.rlike("^[6-9]")
    prefix = F.when(F.contains(col, code), F.concat(code, F.lit(" "))).otherwise("")
    return F.when(usable, F.concat(prefix, F.left(digits, F.lit(10))))


def is_email(col):
    return F.coalesce(col.rlike(K.EMAIL_SHAPE), F.lit(False))


def is_mobile(col):
    number = F.when(F.startswith(col, F.lit(K.COUNTRY_CODE)), F.substr(col, F.lit(len(K.COUNTRY_CODE) + 1))).otherwise(col)
    return F.coalesce(F.length(F.regexp_replace(number, r"(?U)\D", "")) == 10, F.lit(False))


def both(*conditions):
    return reduce(lambda a, b: a & b, conditions)


def either(*conditions):
    return reduce(lambda a, b: a | b, conditions)
