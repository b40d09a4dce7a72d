"""Declared types.

Every field of the profile carries a write rule in its metadata; ``functions.conform`` walks the
type and generates the coercion and the checks from it.

rule      meaning
char      text field: trimmed, lower-cased, digit strings in canonical form
flag      text field holding true / false, kept as BOOLEAN
int       whole number or text of one
float     number or text of one
chars     list of text, elements only trimmed
record    declared object, undeclared keys dropped
records   list of declared objects
open      free object; the listed keys are typed
opens     list of free objects
text      value of a free object, lower-cased, not trimmed
number    value of a free object that counts only when it is a number
oflag     value of a free object holding true / false
otexts    list inside a free object, elements as they are
years     free map of numbers
"""

from pyspark.sql import types as T

S, D, I, B = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType()


def _f(name, dtype, rule, null=True, **more):
    return T.StructField(name, dtype, True, {"rule": rule, "null": null, **more})


def _char(*names, **more):
    return [_f(n, S, "char", blank=True, **more) for n in names]


def _flag(*names):
    return [_f(n, B, "flag", null=False, blank=False) for n in names]


def _text(*names):
    return [_f(n, S, "text") for n in names]


def _record(name, fields, rule="record", null=False):
    return _f(name, T.StructType(fields), rule, null)


def _records(name, fields, rule="records"):
    return _f(name, T.ArrayType(T.StructType(fields)), rule, null=False)


def _chars(name, **more):
    return _f(name, T.ArrayType(S), "chars", null=False, **more)


PERSONAL_KEYS = ("name", "email", "mobile", "city", "country", "linkedin", "github")
SKILL_KINDS = ("languages", "frameworks", "technologies")
SUMMARY_YEARS = (
    "years_of_full_time_experience_after_graduation",
    "total_startup_experience",
    "total_early_stage_startup_experience",
    "product_company_experience",
    "service_company_experience",
)

_PROJECT = _text("project_name", "project_description")
_LEVELS = [_chars("proficient", most=3), _chars("average")]
_COMPANY = [
    *_char("name", "last_position_held", "city", "country", "joining_month_and_year", "leaving_month_and_year"),
    _f("total_duration_in_years", D, "float"),
    *_char("company_size_range", relabel=True),
    *_char("total_capital_raised", "company_type"),
    *_flag("is_faang"),
    *_char("has_the_company_raised_capital_in_the_last_5_years"),
    *_flag("is_startup"),
    *_char("industry_type"),
]
_POSITION = [*_text("position_name", "position_starting_date", "position_ending_date"), _records("projects", _PROJECT, "opens")]

PROFILE = T.StructType(
    [
        _record("personal_information", _text(*PERSONAL_KEYS), "open", null=True),
        *_char("resume_type", "title"),
        _record(
            "skills",
            [
                *[_record(kind, _LEVELS) for kind in SKILL_KINDS],
                _f("total_skill_experience", T.MapType(S, D), "years"),
                *_flag("llm_experience", "gen_ai_experience"),
            ],
        ),
        _records(
            "education",
            [
                *_char("school_name", "degree_name", "city", "country"),
                *[_f(n, I, "int") for n in ("year_of_start", "year_of_graduation", "duration_in_years")],
                *_char("mode", "degree_level"),
                *_flag("is_cs_degree", "is_ml_degree"),
                *_char("institute_type"),
            ],
        ),
        _records(
            "experience",
            [
                _record("company_information", _COMPANY),
                _records("positions_held_within_the_company", _POSITION, "opens"),
                *_char("candidate_company_summary"),
            ],
        ),
        _records("projects_outside_of_work", _PROJECT, "opens"),
        _record(
            "additional_experience_summary",
            [*_text("last_position_held"), *[_f(n, D, "number") for n in SUMMARY_YEARS], _f("gen_ai_experience", B, "oflag")],
            "open",
            null=True,
        ),
        _record(
            "achievements_awards",
            [_f(n, T.ArrayType(S), "otexts") for n in ("summary_of_achievements_awards", "position_blurbs")],
            "open",
            null=True,
        ),
        *_char("overall_summary_of_candidate"),
    ]
)

SKILL_ENTRIES = T.ArrayType(T.StructType([T.StructField("skill", S), T.StructField("years", D)]))


#: Undeclared keys of a free object beside its typed fields, normalised values as JSON text.
OTHER = T.StructField("other", T.MapType(S, S))


def keeps_other(field):
    """Whether the stored form of a field holds ``other``: free objects do, but for the personal one, whose rest is a column of its own."""
    return field.metadata.get("rule") in ("open", "opens") and field.name != "personal_information"


def _plain(dtype, other=False):
    """The same type without rule metadata; free objects with ``other`` behind their fields."""
    if isinstance(dtype, T.StructType):
        fields = [T.StructField(f.name, _plain(f.dataType, keeps_other(f))) for f in dtype]
        return T.StructType([*fields, OTHER] if other else fields)
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_plain(dtype.elementType, other))
    return dtype


def _stored():
    """PROFILE as stored: free objects with ``other``, the experience map followed by its entries in reply order."""
    fields = []
    for f in _plain(PROFILE):
        if f.name == "skills":
            inner = []
            for g in f.dataType:
                inner.append(g)
                if g.name == "total_skill_experience":
                    inner.append(T.StructField("skill_entries", SKILL_ENTRIES))
            f = T.StructField("skills", T.StructType(inner))
        fields.append(f)
    return T.StructType(fields)


PARSED_DATA = _stored()

TRACKING = T.StructType(
    [
        T.StructField("id", S),
        T.StructField("file", S),
        T.StructField("storage_path", S),
        T.StructField("parsing_status", S),
        T.StructField("no_of_retries", I),
        T.StructField("parsed_data_id", S),
        T.StructField("resume_category", S),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("modified_at", T.TimestampType()),
    ]
)
