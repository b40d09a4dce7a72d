"""Decorated results, the flat export and JSON documents."""

import itertools

from pyspark.sql import functions as F

from dossier.operators.export import csv_columns, decorate, json_documents
from dossier.operators.profiles import conform, parse_content
from dossier.sources.files import read_csv, write_csv, write_json
from dossier.workload.registry import query
from dossier.workload.replies import documents
from dossier.workload.star import star_store, work_folder
from dossier.workload.star_sql import PROFILES
from dossier.workload.text_queries import duration_sql

SLOTS = range(1, 6)
_runs = itertools.count()


def _or_empty(expression):
    return f"coalesce(({expression})::VARCHAR, '')"


def _csv_sql():
    out = {
        "Name": "name", "Email": "email", "Mobile": "mobile", "Github": "''", "LinkedIn": "''", "City": "city", "Country": "country", "Title": "title",
    }
    for header, p, a in (("Language", "lang_p", "lang_a"), ("Framework", "fw_p", "fw_a"), ("Technology", "tech_p", "tech_a")):
        out |= {f"{header}{i}": f"list_concat({p}, {a})[{i}]" for i in SLOTS}
    out |= {"LLM Experience": "coalesce(llm, false)", "Gen AI Experience": "coalesce(gen_ai, false)"}
    for i in SLOTS:
        out[f"Skill_Experience_{i}"] = f"entries[{i}].skill"
        out[f"Skill_Experience_Years_{i}"] = f"CASE WHEN len(entries) >= {i} THEN {duration_sql(f'entries[{i}].years')} END"
    studies = {
        "School_Name": "school", "Degree_Name": "degree", "Edu_City": None, "Edu_Country": None, "Year_Of_Start": "y0", "Year_Of_Graduation": "y1",
        "Duration_In_Years": "years", "Degree_Level": "lvl", "Is Cs Degree": "cs", "Is ML Degree": "ml", "Institute Type": "institute",
    }
    work = {
        "Company_Name": "name", "Position_Held": "position", "Exp_City": "city", "Exp_Country": "country", "Joining_Date": "joined",
        "Leaving_Date": "left", "Total_Duration": "duration", "Company Size Range": "size", "Total Capital Raised": None, "Company Type": "type",
        "Is Faang": "faang", "has_the_company_raised_capital_in_the_last_5_years": "raised", "Is Startup": "startup", "Industry Type": "industry",
    }
    for items, headers in (("education", studies), ("experience", work), ("projects", {"Project_Name": "name", "Project_Description": "about"})):
        out |= {f"{h}{i}": f"{items}[{i}].\"{f}\"" if f else "''" for i in SLOTS for h, f in headers.items()}
    out["Last_Position_Held"] = "held"
    for header, f in (
        ("Years_Of_Full_Time_Experience", "ft"), ("Total_Startup_Experience", "st"), ("Total_Early_Stage_Startup_Experience", "es"),
        ("Product_Company_Experience", "pr"), ("Service_Company_Experience", "se"),
    ):
        out[header] = f"CASE WHEN k % 25 <> 3 THEN {duration_sql(f)} END"
    out |= {"Gen_AI_Experience": "sum_gen_ai", "Overall_Summary": "overall"}
    # of the JSON column only values are compared, its text is the writer's own
    out |= {"json_email": "email", "json_first_company": "experience[1].name"}
    return f"WITH {PROFILES} SELECT " + ", ".join(f'{_or_empty(e)} AS "{h}"' for h, e in out.items()) + " FROM profiles"


@query("csv_export", _csv_sql())
def csv_export(spark, sf_dir):
    """All columns, written as CSV files and read back. Plain, the files would be ten times as large as the tables."""
    path = f"{work_folder(spark, sf_dir, 'csv')}-{next(_runs)}"
    write_csv(csv_columns(decorate(star_store(spark, sf_dir))), path, compression="gzip")
    flat = read_csv(spark, path)
    data = F.col("Parsed Data")
    return flat.withColumns(
        {
            "json_email": F.coalesce(F.get_json_object(data, "$.personal_information.email"), F.lit("")),
            "json_first_company": F.coalesce(F.get_json_object(data, "$.experience[0].company_information.name"), F.lit("")),
        }
    ).drop("Parsed Data")


@query(
    "json_export",
    f"""WITH {PROFILES} SELECT profile_id AS id, title, {duration_sql('se')} AS service, k % 25 <> 3 AS has_summary, has_skills,
          entries[1].skill AS first_skill, entries[1].skill IS NOT NULL AS first_skill_found, true AS nulls_kept, len(experience)::INTEGER AS companies
        FROM profiles WHERE k % 25 <> 3
        UNION ALL SELECT profile_id, title, NULL, false, has_skills, entries[1].skill, entries[1].skill IS NOT NULL, true, len(experience)::INTEGER
        FROM profiles WHERE k % 25 = 3""",
)
def json_export(spark, sf_dir):
    """Documents written and read back: values, key order of the experience map, null fields."""
    doc = F.col("document")
    data = "$.parsed_data"
    skills = F.get_json_object(doc, f"{data}.skills.total_skill_experience")
    first = F.nullif(F.regexp_extract(skills, r'^\{"([^"]+)"', 1), F.lit(""))
    path = f"{work_folder(spark, sf_dir, 'json')}-{next(_runs)}"
    write_json(decorate(star_store(spark, sf_dir)), path)
    return spark.read.text(path).withColumnRenamed("value", "document").select(
        F.get_json_object(doc, "$._id").alias("id"),
        F.get_json_object(doc, f"{data}.title").alias("title"),
        F.get_json_object(doc, f"{data}.additional_experience_summary.service_company_experience").alias("service"),
        F.get_json_object(doc, f"{data}.additional_experience_summary").isNotNull().alias("has_summary"),
        F.get_json_object(doc, f"{data}.skills").isNotNull().alias("has_skills"),
        first.alias("first_skill"),
        first.isNotNull().alias("first_skill_found"),
        F.contains(doc, F.lit('"linkedin":null')).alias("nulls_kept"),
        F.coalesce(F.json_array_length(F.get_json_object(doc, f"{data}.experience"))).alias("companies"),
    )


@query(
    "decorate",
    f"""WITH {PROFILES} SELECT profile_id, CASE WHEN k % 25 <> 3 THEN {duration_sql('ft')} END AS full_time,
          CASE WHEN k % 25 <> 3 THEN {duration_sql('st')} END AS startup, CASE WHEN k % 25 <> 3 THEN {duration_sql('es')} END AS early_stage,
          CASE WHEN k % 25 <> 3 THEN {duration_sql('pr')} END AS product, CASE WHEN k % 25 <> 3 THEN {duration_sql('se')} END AS service,
          array_to_string(list_transform(entries, lambda e: e.skill || '=' || {duration_sql('e.years')}), ';') AS skill_years
        FROM profiles""",
)
def decorated(spark, sf_dir):
    data = F.col("parsed_data")
    summary = data["additional_experience_summary"]
    by_skill = data["skills"]["total_skill_experience"]
    pairs = F.transform(data["skills"]["skill_entries"], lambda e: F.concat(e["skill"], F.lit("="), F.try_element_at(by_skill, e["skill"])))
    return decorate(star_store(spark, sf_dir)).select(
        "profile_id",
        summary["years_of_full_time_experience_after_graduation"].alias("full_time"),
        summary["total_startup_experience"].alias("startup"),
        summary["total_early_stage_startup_experience"].alias("early_stage"),
        summary["product_company_experience"].alias("product"),
        summary["service_company_experience"].alias("service"),
        F.array_join(pairs, ";").alias("skill_years"),
    )


@query(
    "top_skills",
    f"WITH {PROFILES}, e AS (SELECT profile_id, entries[1:5] AS five FROM profiles WHERE entries IS NOT NULL) "
    "SELECT profile_id, (unnest(range(len(five))))::INTEGER AS pos, unnest(list_transform(five, lambda e: e.skill)) AS skill, "
    "unnest(list_transform(five, lambda e: e.years)) AS years FROM e",
)
def top_skills(spark, sf_dir):
    """The first five entries of the experience map in their order, whatever the years."""
    five = F.slice(F.col("parsed_data.skills.skill_entries"), 1, 5)
    return star_store(spark, sf_dir).select("profile_id", F.posexplode(five).alias("pos", "entry")).select("profile_id", "pos", "entry.skill", "entry.years")


_UNDECLARED = {
    '"position_name":': '"Grade": "SENIOR", "position_name":',
    '"projects_outside_of_work": []': '"projects_outside_of_work": [{"project_name": "P", "Budget": "0050", "Team": {"Lead": "ANN"}}]',
    '"product_company_experience":': '"Total": {"Months": ["Keep", {"N": "007"}]}, "product_company_experience":',
    '"overall_summary_of_candidate"': '"achievements_awards": {"summary_of_achievements_awards": ["A"], "Rank": true}, "overall_summary_of_candidate"',
}


@query(
    "open_remainders",
    """SELECT c_custkey, form, CASE WHEN c_custkey % 41 <> 20 THEN '' || (c_custkey % 90) END AS age, 'senior' AS grade, '50' AS budget, 'ann' AS lead,
          '["Keep",{"N":7}]' AS months, 'true' AS rank, true AS typed_too
        FROM customer, (VALUES ('csv'), ('json')) t(form)""",
)
def open_remainders(spark, sf_dir):
    """Keys of free objects that no field is declared for come back in the JSON documents and in the JSON column of the CSV."""
    body = F.col("body")
    for known, more in _UNDECLARED.items():
        body = F.replace(body, F.lit(known), F.lit(more))
    replies = documents(spark, sf_dir).select(F.col("doc_id").alias("profile_id"), body.alias("content"))
    profiles = decorate(conform(parse_content(replies)))
    written = json_documents(profiles).select(F.lit("json").alias("form"), F.get_json_object("document", "$.parsed_data").alias("data"))
    flat = csv_columns(profiles).select(F.lit("csv").alias("form"), F.col("Parsed Data").alias("data"))

    def at(path):
        return F.get_json_object("data", f"$.{path}")

    return written.unionByName(flat).select(
        F.regexp_extract(at("overall_summary_of_candidate"), "[0-9]+", 0).cast("bigint").alias("c_custkey"),
        "form",
        at("personal_information.age").alias("age"),
        at("experience[0].positions_held_within_the_company[0].Grade").alias("grade"),
        at("projects_outside_of_work[0].Budget").alias("budget"),
        at("projects_outside_of_work[0].Team.Lead").alias("lead"),
        at("additional_experience_summary.Total.Months").alias("months"),
        at("achievements_awards.Rank").alias("rank"),
        at("additional_experience_summary.product_company_experience").isNotNull().alias("typed_too"),
    )
