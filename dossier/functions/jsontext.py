"""From a chat reply to a JSON value."""

from pyspark.sql import functions as F

from dossier import constants as K
from dossier.functions.text import strip


def reply_content(reply):
    return F.get_json_object(reply, "$.choices[0].message.content")


def without_fences(content):
    return strip(F.regexp_replace(content, "```json|```", ""))


def boxed(text):
    """The text inside brackets as VARIANT, NULL when that is no JSON.

    The parser alone would accept anything behind the first value; inside brackets it cannot.
    """
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))


def unboxed(box):
    """The one value of a box, NULL when there are more."""
    return F.when(F.try_variant_get(box, "$[1]", "variant").isNull(), F.try_variant_get(box, "$[0]", "variant"))


def repaired(text):
    """Text with trailing commas dropped, quotes made double, keys quoted and braces added."""
    text = F.regexp_replace(text, K.TRAILING_COMMA, "$1")
    text = F.replace(text, F.lit("'"), F.lit('"'))
    text = F.regexp_replace(text, K.BARE_KEY, '$1"$2":')
    return F.when(text.rlike(K.OPENED), text).otherwise(F.concat(F.lit("{"), text, F.lit("}")))
