"""Decorated results and their wide, flat form."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier import schema
from dossier.constants import EXPORT_SLOTS
from dossier.functions.durations import years_and_months

# --- fixed values: export headers and the fields below them; * is the slot number ---------------
# City and Country occur for education and experience alike, hence the prefixes.
PERSONAL = {"Name": "name", "Email": "email", "Mobile": "mobile", "Github": "github", "LinkedIn": "linkedin", "City": "city", "Country": "country"}
SKILL_HEADERS = {"Language*": "languages", "Framework*": "frameworks", "Technology*": "technologies"}
FLAGS = {"LLM Experience": "llm_experience", "Gen AI Experience": "gen_ai_experience"}
YEARS = ("Skill_Experience_*", "Skill_Experience_Years_*")
EDUCATION = {
    "School_Name*": "school_name",
    "Degree_Name*": "degree_name",
    "Edu_City*": "city",
    "Edu_Country*": "country",
    "Year_Of_Start*": "year_of_start",
    "Year_Of_Graduation*": "year_of_graduation",
    "Duration_In_Years*": "duration_in_years",
    "Degree_Level*": "degree_level",
    "Is Cs Degree*": "is_cs_degree",
    "Is ML Degree*": "is_ml_degree",
    "Institute Type*": "institute_type",
}
EXPERIENCE = {
    "Company_Name*": "name",
    "Position_Held*": None,  # first position of the company
    "Exp_City*": "city",
    "Exp_Country*": "country",
    "Joining_Date*": "joining_month_and_year",
    "Leaving_Date*": "leaving_month_and_year",
    "Total_Duration*": "total_duration_in_years",
    "Company Size Range*": "company_size_range",
    "Total Capital Raised*": "total_capital_raised",
    "Company Type*": "company_type",
    "Is Faang*": "is_faang",
    "has_the_company_raised_capital_in_the_last_5_years*": "has_the_company_raised_capital_in_the_last_5_years",
    "Is Startup*": "is_startup",
    "Industry Type*": "industry_type",
}
PROJECTS = {"Project_Name*": "project_name", "Project_Description*": "project_description"}
SUMMARY = {
    "Last_Position_Held": "last_position_held",
    "Years_Of_Full_Time_Experience": "years_of_full_time_experience_after_graduation",
    "Total_Startup_Experience": "total_startup_experience",
    "Total_Early_Stage_Startup_Experience": "total_early_stage_startup_experience",
    "Product_Company_Experience": "product_company_experience",
    "Service_Company_Experience": "service_company_experience",
    "Gen_AI_Experience": "gen_ai_experience",
}


def decorate(df):
    """Years of every skill and of the summary as text, for JSON and CSV alike."""
    data = F.col("parsed_data")
    entries = F.transform(
        data["skills"]["skill_entries"],
        lambda e: F.struct(e.skill.alias("skill"), years_and_months(e.years).alias("years")),
    )
    # from the entries, so that the map is in reply order as well
    years = F.map_from_entries(entries)
    skills = data["skills"].withField("skill_entries", entries).withField("total_skill_experience", years)
    summary = data["additional_experience_summary"]
    for name in schema.SUMMARY_YEARS:
        summary = summary.withField(name, years_and_months(data["additional_experience_summary"][name]))
    return df.withColumn("parsed_data", data.withField("skills", skills).withField("additional_experience_summary", summary))


def skill_slots(skills):
    """First skills of a kind: proficient ones, then average ones."""
    none = F.array().cast("array<string>")
    return F.slice(F.concat(F.coalesce(skills["proficient"], none), F.coalesce(skills["average"], none)), 1, EXPORT_SLOTS)


def csv_columns(df):
    """The flat columns of decorated profiles, all text, '' where there is nothing."""
    data = F.col("parsed_data")
    out = {h: data["personal_information"][f] for h, f in PERSONAL.items()}
    out["Title"] = data["title"]
    for header, kind in SKILL_HEADERS.items():
        out |= _slots(header, skill_slots(data["skills"][kind]), lambda item: item)
    out |= {h: F.coalesce(data["skills"][f], F.lit(False)) for h, f in FLAGS.items()}
    skill, years = YEARS
    for i in range(EXPORT_SLOTS):
        entry = F.get(data["skills"]["skill_entries"], F.lit(i))
        out |= {skill.replace("*", str(i + 1)): entry["skill"], years.replace("*", str(i + 1)): entry["years"]}
    out |= _groups(EDUCATION, data["education"], lambda item, f: item[f])
    out |= _groups(EXPERIENCE, data["experience"], _company)
    out |= _groups(PROJECTS, data["projects_outside_of_work"], lambda item, f: item[f])
    out |= {h: data["additional_experience_summary"][f] for h, f in SUMMARY.items()}
    out["Overall_Summary"] = data["overall_summary_of_candidate"]
    out["Parsed Data"] = json_text(df)
    return df.select(*[F.coalesce(c.cast("string"), F.lit("")).alias(h) for h, c in out.items()])


def _company(item, field):
    if field is None:
        return F.get(item["positions_held_within_the_company"], F.lit(0))["position_name"]
    return item["company_information"][field]


def _slots(header, items, pick):
    return {header.replace("*", str(i + 1)): pick(F.get(items, F.lit(i))) for i in range(EXPORT_SLOTS)}


def _groups(headers, items, pick):
    """All headers of slot 1, then of slot 2 and so on."""
    out = {}
    for i in range(EXPORT_SLOTS):
        item = F.get(items, F.lit(i))
        out |= {h.replace("*", str(i + 1)): pick(item, f) for h, f in headers.items()}
    return out


def json_text(df):
    """Profiles as JSON with their null fields; undeclared keys are among the fields of their object again."""
    data = F.col("parsed_data")
    dtype = df.schema["parsed_data"].dataType
    if "other_contacts" in df.columns:
        personal = data["personal_information"]
        rest = F.when(personal.isNotNull(), personal.withField(schema.OTHER.name, F.col("other_contacts")))
        data = data.withField("personal_information", rest)
        dtype = _replaced(dtype, "personal_information", lambda t: T.StructType([*t, schema.OTHER]))
    data = data.withField("skills", data["skills"].dropFields("skill_entries"))
    dtype = _replaced(dtype, "skills", lambda t: T.StructType([f for f in t if f.name != "skill_entries"]))
    return _json(data, dtype)


def _replaced(dtype, name, change):
    return T.StructType([T.StructField(f.name, change(f.dataType) if f.name == name else f.dataType) for f in dtype])


def _holds_other(dtype):
    if isinstance(dtype, T.ArrayType):
        return _holds_other(dtype.elementType)
    return isinstance(dtype, T.StructType) and any(f.name == schema.OTHER.name or _holds_other(f.dataType) for f in dtype)


def _json(value, dtype):
    """JSON text of a value, NULL of none. Only objects on the way to an ``other`` are put together from parts."""
    if not _holds_other(dtype):
        return F.to_json(value, {"ignoreNullFields": "false"})
    if isinstance(dtype, T.ArrayType):
        items = F.transform(value, lambda e: F.coalesce(_json(e, dtype.elementType), F.lit("null")))
        return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))

    def written(s):
        parts, plain = [], []

        def flush():
            if plain:
                text = F.to_json(F.struct(*[s[n].alias(n) for n in plain]), {"ignoreNullFields": "false"})
                parts.append(F.substr(text, F.lit(2), F.length(text) - 2))
                plain.clear()

        for f in dtype:
            if f.name == schema.OTHER.name:
                continue
            if not _holds_other(f.dataType):
                plain.append(f.name)
                continue
            flush()
            parts.append(F.concat(F.lit(f'"{f.name}":'), F.coalesce(_json(s[f.name], f.dataType), F.lit("null"))))
        flush()
        if schema.OTHER.name in dtype.names:
            parts.append(_rest(s[schema.OTHER.name]))
        # a part that is NULL is left out
        return F.when(s.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))

    return F.get(F.transform(F.array(value), written), F.lit(0))


def _rest(other):
    """The entries of ``other`` as they stand in an object, NULL if there are none."""

    def entry(e):
        key = F.to_json(F.array(e["key"]))
        return F.concat(F.substr(key, F.lit(2), F.length(key) - 2), F.lit(":"), e["value"])

    return F.when(F.size(other) > 0, F.array_join(F.transform(F.map_entries(other), entry), ","))


def json_documents(df):
    """One JSON document per profile, the id as text."""
    key = F.to_json(F.array(F.col("profile_id").cast("string")))
    key = F.coalesce(F.substr(key, F.lit(2), F.length(key) - 2), F.lit("null"))
    text = F.concat(F.lit('{"_id":'), key, F.lit(',"parsed_data":'), F.coalesce(json_text(df), F.lit("null")), F.lit("}"))
    return df.select(text.alias("document"))
