import json
import random

from pyspark.sql import functions as F

from dossier import schema
from dossier.functions import conform as C
from dossier.operators.export import csv_columns, decorate, json_documents
from dossier.operators.profiles import conform, parse_content, unwrap_replies

GOOD = {
    "personal_information": {"name": "Ann B", "email": "A@X.com", "mobile": 9876543210, "age": "007", "tags": [1, "A"]},
    "title": " 007 ",
    "resume_type": "Backend_Engineer",
    "skills": {
        "languages": {"proficient": [" Python ", "Go"], "average": [], "extra": 1},
        "total_skill_experience": {"Zed": 1, "alpha": "2.5", "node.js": "3", "B": True, "n": None},
        "llm_experience": True,
        "gen_ai_experience": "FALSE",
    },
    "education": [{"year_of_start": "2010", "year_of_graduation": 2014.0, "is_cs_degree": True, "other": 1}, {}],
    "experience": [{"company_information": {"total_duration_in_years": "2.5", "company_size_range": ">50"}, "positions_held_within_the_company": []}],
    "additional_experience_summary": {"product_company_experience": 2, "service_company_experience": "3", "total_startup_experience": "2.5"},
}


def run(spark, contents):
    replies = [(i, json.dumps({"choices": [{"message": {"content": c}}]})) for i, c in enumerate(contents)]
    df = conform(parse_content(unwrap_replies(spark.createDataFrame(replies, "i int, reply string"))))
    return df.select("i", "parsed_data", "other_contacts", "errors", "repaired").orderBy("i").collect()


def test_values(spark):
    row = run(spark, ["```json\n" + json.dumps(GOOD) + "\n```"])[0]
    d = row.parsed_data
    assert row.errors == [] and not row.repaired
    assert (d.title, d.resume_type, d.personal_information.email, d.personal_information.mobile) == ("7", "backend_engineer", "a@x.com", "9876543210")
    assert row.other_contacts == {"age": "7", "tags": '[1,"A"]'}
    assert d.skills.languages.proficient == ["Python", "Go"]
    assert [tuple(e) for e in d.skills.skill_entries] == [("Zed", 1.0), ("alpha", None), ("node.js", 3.0), ("B", None), ("n", None)]
    assert d.skills.total_skill_experience == {"Zed": 1.0, "alpha": None, "node.js": 3.0, "B": None, "n": None}
    assert (d.skills.llm_experience, d.skills.gen_ai_experience) == (True, False)
    assert (d.education[0].year_of_start, d.education[0].year_of_graduation, d.education[0].is_cs_degree) == (2010, 2014, True)
    assert d.education[1].year_of_start is None and d.projects_outside_of_work is None
    company = d.experience[0].company_information
    assert (company.total_duration_in_years, company.company_size_range) == (2.5, "<50")
    s = d.additional_experience_summary
    assert (s.product_company_experience, s.service_company_experience, s.total_startup_experience) == (2.0, 3.0, None)


REASONS = [
    ({"skills": None}, "null:skills"),
    ({"skills": "x"}, "type:skills"),
    ({"skills": {"languages": {"proficient": ["a", "b", "c", "d"]}}}, "too_many:skills.languages.proficient"),
    ({"skills": {"languages": {"average": None}}}, "null:skills.languages.average"),
    ({"skills": {"languages": {"average": "x"}}}, "type:skills.languages.average"),
    ({"skills": {"languages": {"average": [None]}}}, "null:skills.languages.average[]"),
    ({"skills": {"languages": {"average": [True]}}}, "type:skills.languages.average[]"),
    ({"skills": {"llm_experience": " "}}, "blank:skills.llm_experience"),
    ({"skills": {"gen_ai_experience": None}}, "null:skills.gen_ai_experience"),
    ({"skills": {"total_skill_experience": [1]}}, "type:skills.total_skill_experience"),
    ({"title": {"a": 1}}, "type:title"),
    ({"education": None}, "null:education"),
    ({"education": [1]}, "type:education[]"),
    ({"education": [{"year_of_start": "soon"}]}, "type:education[].year_of_start"),
    ({"education": [{"year_of_start": 2010.5}]}, "type:education[].year_of_start"),
    ({"education": [{}, {"is_ml_degree": None}]}, "null:education[].is_ml_degree"),
    ({"experience": [{"company_information": {"total_duration_in_years": "long"}}]}, "type:experience[].company_information.total_duration_in_years"),
    ({"experience": [{"company_information": None}]}, "null:experience[].company_information"),
    ({"experience": [{"company_information": {"is_faang": ""}}]}, "blank:experience[].company_information.is_faang"),
    ({"experience": [{"positions_held_within_the_company": ["x"]}]}, "type:experience[].positions_held_within_the_company[]"),
    ({"projects_outside_of_work": None}, "null:projects_outside_of_work"),
    ({"personal_information": [1]}, "type:personal_information"),
]


def test_reasons(spark):
    rows = run(spark, [json.dumps(change) for change, _ in REASONS])
    assert [r.errors for r in rows] == [[reason] for _, reason in REASONS]


def test_nullable_parts_are_accepted(spark):
    fine = {"personal_information": None, "title": None, "resume_type": "", "additional_experience_summary": None, "achievements_awards": None}
    fine |= {"skills": {"total_skill_experience": None}, "education": [{"year_of_start": None, "mode": ""}]}
    # of an empty text the repair makes an empty object
    assert [r.errors for r in run(spark, [json.dumps(fine), "{}", ""])] == [[], [], []]


def test_syntax_and_repair(spark):
    rows = run(spark, ["{'title':'X',resume_type:'y',}", "'title': 'A'", "nope {", "[1]", '{"title":"x"} y', '{"a":1},{"b":2}'])
    assert [r.repaired for r in rows] == [True, True, False, False, False, False]
    assert (rows[0].parsed_data.title, rows[0].parsed_data.resume_type, rows[1].parsed_data.title) == ("x", "y", "a")
    assert [r.errors for r in rows[2:]] == [["syntax:$"], ["type:$"], ["syntax:$"], ["syntax:$"]]


def test_stored_type(spark):
    df = conform(parse_content(spark.createDataFrame([("{}",)], "content string")))
    assert df.schema["parsed_data"].dataType.simpleString() == schema.PARSED_DATA.simpleString()


def test_no_python_in_the_plan(spark):
    df = conform(parse_content(spark.createDataFrame([("{}",)], "content string").where(F.lit(True))))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_of_repeated_keys_the_last_counts(spark):
    from dossier.operators.profiles import parse_content

    text = '{"title": "A", "skills": {"total_skill_experience": {"x": 1, "x": 2}}, "title": "B"}'
    row = conform(parse_content(spark.createDataFrame([(text,)], "content string"))).select("parsed_data.title", "parsed_data.skills.skill_entries", "errors").first()
    assert row.title == "b" and [(e.skill, e.years) for e in row.skill_entries] == [("x", 2.0)] and "syntax:$" not in row.errors


def plainly(value):
    """The value rules, object by object."""
    for k, v in value.items():
        if isinstance(v, dict):
            value[k] = plainly(v)
        elif isinstance(v, list):
            value[k] = [plainly(i) if isinstance(i, dict) else i for i in v]
        elif isinstance(v, bool):
            value[k] = str(v).lower()
        elif isinstance(v, str):
            value[k] = int(v) if v.isdigit() else v.lower()
    return value


def test_values_are_normalised_at_any_depth(spark):
    r = random.Random(1)
    texts = ["ABC", "007", "0", "000", 'x"Y', "[[", ",[", '":"Z"', "É\n\\", "true", ":true", '{"A":"B"}', '"', "\\", "2.50", "12a"]

    def value(depth):
        c = r.random()
        if depth < 6 and c < 0.3:
            return {r.choice(["A", "b", '"q', ":", "É", "k,["]): value(depth + 1) for _ in range(r.randint(0, 3))}
        if depth < 6 and c < 0.55:
            return [value(depth + 1) for _ in range(r.randint(0, 3))]
        return r.choice([*texts, True, False, None, 2.5, 7])

    found = [{"r": value(0), "Z": value(0)} for _ in range(400)]
    deep = "UP"
    for _ in range(60):
        deep = {"K": [deep, [deep if isinstance(deep, str) else "X"]]} if isinstance(deep, str) else {"K": deep}
    found += [{"r": deep}, {"r": [[{"A": "B"}], {"A": "B"}]}, {"r": ["A" * 20_000, {"A": '\\"B' * 5_000}]}]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(found)], "i int, t string").select("i", F.parse_json("t").alias("v"))
    for row in df.select("i", C.normalised(F.try_variant_get("v", "$", "map<string,variant>")).alias("m")).collect():
        wanted = plainly(found[row.i])
        assert json.dumps({k: json.loads(v) for k, v in row.m.items()}, sort_keys=True) == json.dumps(wanted, sort_keys=True)


def test_undeclared_keys_come_back(spark):
    """Of the free objects alone, at their place, normalised; objects without any look as before."""
    sent = GOOD | {
        "experience": [{"positions_held_within_the_company": [{"position_name": "Dev", "Level": "TOP", "projects": [{"project_name": "P", "Cost": "007"}, {}]}, {"other": {"A": "B"}}], "extra": 1}],
        "projects_outside_of_work": [{"project_name": "Q", 'odd "key"': [{"A": "B"}, "C"]}, {}],
        "additional_experience_summary": {"product_company_experience": 2, "Months": 2.5, "None": None},
        "achievements_awards": {"Rank": True},
    }
    wrapped = [(1, json.dumps({"choices": [{"message": {"content": json.dumps(sent)}}]}))]
    df = conform(parse_content(unwrap_replies(spark.createDataFrame(wrapped, "profile_id int, reply string"))))
    assert df.first().errors == []
    profiles = decorate(df)
    document = json.loads(json_documents(profiles).first().document)
    data = document["parsed_data"]
    assert document["_id"] == "1" and json.loads(csv_columns(profiles).first()["Parsed Data"]) == data
    first, second = data["experience"][0]["positions_held_within_the_company"]
    assert first["Level"] == "top" and first["position_name"] == "dev" and second["other"] == {"A": "b"} and "extra" not in data["experience"][0]
    assert first["projects"] == [{"project_name": "p", "project_description": None, "Cost": 7}, {"project_name": None, "project_description": None}]
    assert data["projects_outside_of_work"][0]['odd "key"'] == [{"A": "b"}, "C"] and list(data["projects_outside_of_work"][1]) == ["project_name", "project_description"]
    assert data["additional_experience_summary"]["Months"] == 2.5 and data["additional_experience_summary"]["None"] is None
    assert data["achievements_awards"] == {"summary_of_achievements_awards": None, "position_blurbs": None, "Rank": "true"}
    assert data["personal_information"]["age"] == 7 and data["personal_information"]["tags"] == [1, "A"]
    assert list(data)[:4] == ["personal_information", "resume_type", "title", "skills"] and "skill_entries" not in data["skills"]
