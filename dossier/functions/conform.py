"""Coercion and checks of a profile held as VARIANT, generated from the rules in ``schema``.

Two passes over the same type: ``typed`` builds the typed value and ``problems`` the list of
broken rules as ``kind:path``. A free object is never a reason to reject what is inside it.
"""

from pyspark.sql import functions as F

from dossier import constants as K
from dossier import schema
from dossier.functions.text import either, strip

WHOLE = r"^\s*([+-]?[0-9]+)(?:\.0*)?\s*$"
NUMBER = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\s*$"


def _none():
    return F.array().cast("array<string>")


def once(value, body):
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def variants(dtype):
    """DDL of a struct with the same names and VARIANT fields."""
    return "struct<" + ",".join(f"`{f.name}`:variant" for f in dtype) + ">"


def opened(x, dtype):
    return F.try_variant_get(x, "$", variants(dtype))


def as_text(x):
    return F.try_variant_get(x, "$", "string")


def as_list(x):
    return F.try_variant_get(x, "$", "array<variant>")


def _kind(x):
    return F.schema_of_variant(x)


def _nested(x):
    """The kind is asked for only where the text looks like an object or a list."""
    return F.left(as_text(x), F.lit(1)).isin("{", "[") & _kind(x).rlike("^(OBJECT|ARRAY)")


def _null(x):
    return F.coalesce(F.is_variant_null(x), F.lit(False))


def lowered(text):
    """Lower case; a string of digits loses its leading zeros, as a number would."""
    return F.regexp_replace(F.lower(text), r"^0+(?=[0-9]+\z)", "")


def number(x):
    """A JSON number or a string of digits as DOUBLE; other strings are no numbers."""

    def checked(text):
        usable = text.rlike(r"^[0-9]+\z") | (text.rlike(NUMBER) & (_kind(x) != "STRING"))
        return F.when(usable, text.try_cast("double"))

    return once(as_text(x), checked)


def _matched(text, pattern, dtype):
    """The first group as a number; only text that matches is cast, as a failing cast is slow."""
    return once(text, lambda t: F.when(t.rlike(pattern), F.regexp_extract(t, pattern, 1).try_cast(dtype)))


def _looked_up(pairs, text):
    return F.try_element_at(F.create_map(*[F.lit(v) for pair in pairs.items() for v in pair]), text)


def _flag(text):
    return _looked_up({"true": True, "false": False}, text)


# --- typed value -----------------------------------------------------------------------------


def typed(x, field):
    """The VARIANT ``x`` as the declared type of ``field``; NULL where it cannot be."""
    rule, dtype = field.metadata["rule"], field.dataType
    if rule in ("record", "open"):
        return once(opened(x, dtype), lambda s: _object(s, dtype, x if schema.keeps_other(field) else None))
    if rule == "records":
        inner = dtype.elementType
        items = F.transform(as_list(x), lambda e: opened(e, inner))
        return F.transform(items, lambda s: _object(s, inner))
    if rule == "opens":
        inner = dtype.elementType
        return F.transform(as_list(x), lambda e: once(opened(e, inner), lambda s: _object(s, inner, e)))
    if rule == "char":
        text = lowered(strip(as_text(x)))
        return once(text, lambda t: F.coalesce(_looked_up(K.COMPANY_SIZE_RELABEL, t), t)) if field.metadata.get("relabel") else text
    if rule == "text":
        return lowered(as_text(x))
    if rule == "flag":
        return _flag(F.lower(strip(as_text(x))))
    if rule == "oflag":
        return _flag(F.lower(as_text(x)))
    if rule == "int":
        return _matched(as_text(x), WHOLE, "int")
    if rule == "float":
        return _matched(as_text(x), NUMBER, "double")
    if rule == "number":
        return number(x)
    if rule == "chars":
        return F.transform(as_list(x), lambda e: strip(as_text(e)))
    if rule == "otexts":
        return F.transform(as_list(x), as_text)
    if rule == "years":
        return F.transform_values(F.try_variant_get(x, "$", "map<string,variant>"), lambda k, v: number(v))
    raise ValueError(f"unknown rule {rule}")


def _object(s, dtype, whole=None):
    """The typed fields of an opened object, and the rest of it if the ``whole`` is given."""
    rest = [] if whole is None else [other_keys(whole, dtype.names).alias(schema.OTHER.name)]
    return F.when(s.isNotNull(), F.struct(*[typed(s[f.name], f).alias(f.name) for f in dtype], *rest))


# --- broken rules ----------------------------------------------------------------------------


def _when(condition, kind, path):
    return F.when(condition, F.lit(f"{kind}:{path}"))


def _listed(*reasons):
    return F.array_compact(F.array(*reasons))


def problems(x, field, path):
    """Reasons to reject ``x`` as ARRAY<STRING>; missing fields are never a reason."""
    meta, rule, dtype = field.metadata, field.metadata["rule"], field.dataType
    given = x.isNotNull() & ~_null(x)
    null = [] if meta["null"] else [_when(_null(x), "null", path)]
    if rule in ("text", "number", "oflag", "otexts"):
        return None
    if rule == "years":
        return _listed(_when(given & F.try_variant_get(x, "$", "map<string,variant>").isNull(), "type", path))
    if rule in ("char", "flag"):
        blank = [] if meta["blank"] else [_when(given & (strip(as_text(x)) == ""), "blank", path)]
        return _listed(*null, *blank, _when(given & _nested(x), "type", path))
    if rule in ("int", "float"):
        return _listed(*null, _when(given & typed(x, field).isNull(), "type", path))
    if rule == "chars":
        own = _when(given & as_list(x).isNull(), "type", path)
        return once(as_list(x), lambda items: _listed(*null, own, *_item_problems(items, meta, path)))
    if rule == "open":
        return _listed(*null, _when(given & opened(x, dtype).isNull(), "type", path))
    if rule == "record":

        def inside(s):
            return _with_inner(_listed(*null, _when(given & s.isNull(), "type", path)), s, dtype, path)

        return once(opened(x, dtype), inside)
    # lists of objects; the list itself may be missing but not null
    inner = dtype.elementType
    own = _listed(*null, _when(given & as_list(x).isNull(), "type", path))
    item_path = path + "[]"

    def each(items):
        wrong = _listed(_when(F.exists(items, lambda s: s.isNull()), "type", item_path))
        if rule == "opens":
            return wrong
        return F.concat(wrong, F.flatten(F.transform(items, lambda s: _with_inner(_none(), s, inner, item_path))))

    found = once(F.transform(as_list(x), lambda e: opened(e, inner)), each)
    return F.concat(own, F.coalesce(found, _none()))


def _item_problems(items, meta, path):
    if "most" in meta:
        yield _when(F.size(items) > meta["most"], "too_many", path)
    yield _when(F.exists(items, F.is_variant_null), "null", path + "[]")
    yield _when(F.exists(items, lambda e: _kind(e).rlike("^(OBJECT|ARRAY|BOOLEAN)")), "type", path + "[]")


def _with_inner(own, s, dtype, path):
    inner = [problems(s[f.name], f, f"{path}.{f.name}".lstrip(".")) for f in dtype]
    return F.concat(own, *[p for p in inner if p is not None])


def profile_problems(s, dtype):
    """Sorted distinct reasons for a whole profile opened one level."""
    return F.array_sort(F.array_distinct(_with_inner(_none(), s, dtype, "")))


# --- the parts a struct cannot hold ------------------------------------------------------------


def ordered_years(text):
    """The experience map of a reply as entries in reply order; of a repeated key the last value counts."""
    skills = F.from_json(text, "skills struct<total_skill_experience map<string,variant>>").skills
    entries = F.map_entries(skills.total_skill_experience)
    pairs = F.transform(entries, lambda e: F.struct(e.key.alias("skill"), number(e.value).alias("years")))

    def last_of_each(pairs):
        def picked(keys):
            last = F.transform(keys, lambda k: F.try_element_at(F.filter(pairs, lambda p: p.skill == k), F.lit(-1)))
            return F.when(F.size(keys) == F.size(pairs), pairs).otherwise(last)

        return once(F.array_distinct(F.transform(pairs, lambda p: p.skill)), picked)

    return once(pairs, last_of_each)


def other_keys(x, known):
    """Keys of a free object that have no typed field, normalised values as JSON text."""
    entries = F.try_variant_get(x, "$", "map<string,variant>")
    return normalised(F.map_filter(entries, lambda k, v: ~k.isin(list(known))))


def normalised(entries):
    """A free map of VARIANT under the value rules, values as JSON text: 2.5 and "2.5" stay apart."""
    return F.transform_values(entries, lambda k, v: F.substr(normal_json(F.concat(F.lit('"":'), F.to_json(v))), F.lit(4)))


_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_TOKEN = rf'{_STRING}(?::(?:{_STRING}|true|false))?|[\[\]{{}}]|[^"\[\]{{}}]+'


def normal_json(text):
    """JSON text without white space (as VARIANT writes it) with the values of its objects normalised, at any depth.

    A text value is lower-cased, one of digits becomes a number, truth values become text. Elements of lists stay as they
    are unless they are objects, and so does everything in a list that is itself an element of a list. A value is told by
    the key before it, so the text is cut into tokens, of which a key with such a value is one, and no level is entered.
    """
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    plain = F.array_join(F.transform(tokens, _normal_token), "")
    listed = text.rlike(r"[\[,]\[")  # perhaps a list in a list, or a text that looks like it

    def guarded(tokens):
        return once(_kept(tokens), lambda kept: F.array_join(F.transform(tokens, lambda t, i: F.when(F.substr(kept, i + 1, F.lit(1)) == "1", t).otherwise(_normal_token(t))), ""))

    return F.when(listed, once(tokens, guarded)).otherwise(plain)


def _normal_token(token):
    value = F.regexp_extract(token, f"^{_STRING}:({_STRING}|true|false)$", 1)

    def changed(value):
        digits = F.regexp_replace(value, '^"0*([0-9]+)"$', "$1")
        new = F.when(value.isin("true", "false"), F.concat(F.lit('"'), value, F.lit('"'))).when(value.rlike('^"[0-9]+"$'), digits).otherwise(F.lower(value))
        return F.when(value == "", token).otherwise(F.concat(F.left(token, F.length(token) - F.length(value)), new))

    return F.when(F.left(token, F.lit(1)) == '"', once(value, changed)).otherwise(token)


def _kept(tokens):
    """A digit a token: 1 inside a list that is an element of a list."""
    start = F.struct(F.lit("").alias("open"), F.lit(0).alias("deep"), F.lit("").alias("kept"))

    def step(at, token):
        up, down = token.isin("[", "{"), token.isin("]", "}")
        inner = (at["deep"] > 0) | ((token == "[") & (F.right(at["open"], F.lit(1)) == "["))
        deep = F.when(up & inner, at["deep"] + 1).when(down & (at["deep"] > 0), at["deep"] - 1).otherwise(at["deep"])
        path = F.when(up & ~inner, F.concat(at["open"], token)).when(down & (at["deep"] == 0), F.left(at["open"], F.length(at["open"]) - 1)).otherwise(at["open"])
        return F.struct(path.alias("open"), deep.alias("deep"), F.concat(at["kept"], F.when(at["deep"] > 0, "1").otherwise("0")).alias("kept"))

    return F.aggregate(tokens, start, step, lambda at: at["kept"])
