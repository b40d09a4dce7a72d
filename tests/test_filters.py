import pytest
from pyspark.sql import functions as F

from dossier import FilterError, FilterSpec, retrieve
from dossier.sources.store import promote
from dossier.workload.star import star_store


@pytest.fixture(scope="module")
def people(make_profiles):
    return make_profiles(
        {
            "nothing": {},
            "empty": {"education": [], "experience": [], "projects_outside_of_work": [], "skills": {"languages": {"proficient": []}}},
            "nulls": {"education": [{}], "skills": {"languages": {"proficient": [None]}}, "experience": [{"company_information": {}}]},
            "split": {
                "education": [{"degree_level": "masters", "is_ml_degree": False, "institute_type": "iit"}, {"degree_level": "bachelors", "is_ml_degree": True}],
                "skills": {
                    "languages": {"proficient": ["python"], "average": ["go"]},
                    "frameworks": {"average": ["flask", ""]},
                    "total_skill_experience": {"python": 5.0, "node.js": 2.0, "Java": 9.0, "text": None},
                    "llm_experience": False,
                },
                "additional_experience_summary": {
                    "product_company_experience": 1.5,
                    "last_position_held": "senior data (nlp) lead",
                    "years_of_full_time_experience_after_graduation": 0.0,
                },
                "resume_type": "natural_language_processing_(nlp)_engineer",
                "projects_outside_of_work": [{"project_name": "p"}],
                "experience": [{"company_information": {"industry_type": "fin.tech", "company_size_range": "<50"}}],
            },
        }
    )


def ids(people, literal=False, **params):
    found = retrieve(people, FilterSpec.from_params(params, literal=literal))
    again = retrieve(promote(people), FilterSpec.from_params(params, literal=literal))
    out = sorted(r.profile_id for r in found.collect())
    assert out == sorted(r.profile_id for r in again.collect())
    return out


ALL = ["empty", "nothing", "nulls", "split"]


@pytest.mark.parametrize(
    "params, want",
    [
        ({}, ALL),
        ({"unknown": "x", "format_type": "csv", "time_filter": "seven_day"}, ALL),
        ({"full_time_experience": "0"}, ALL),
        ({"full_time_experience": "-1"}, ["split"]),
        ({"company_type": "Product"}, ALL),
        ({"company_type": "product"}, ["split"]),
        ({"company_type": "product", "product_company_experience": "2"}, []),
        ({"degree_type": "MASTERS", "is_ml_degree": "TRUE", "institute_type": "All"}, ["split"]),
        ({"is_ml_degree": "false"}, ["split"]),
        ({"is_cs_degree": "false"}, []),
        ({"llm_experience": "no"}, ["split"]),
        ({"gen_ai_experience": "false"}, []),
        ({"degree_type": "m.*s"}, ["split"]),
        ({"institute_type": "i.t"}, []),
        ({"last_position_held": "Data (NLP)"}, ["split"]),
        ({"last_position_held": "d.ta"}, []),
        ({"resume_type": "natural_language_processing_(NLP)_engineer"}, []),
        ({"projects_outside_of_work": "false"}, ["split"]),
        ({"skills_and": "python, go ,flask"}, ["split"]),
        ({"skills_and": "python,"}, ["split"]),
        ({"skills_and": "Python"}, []),
        ({"proficient_technologies_and": "python,go"}, []),
        ({"skills_or": "x,go"}, ["split"]),
        ({"proficient_technologies_or": "go"}, []),
        ({"skills_or": "x", "proficient_technologies_or": "python"}, ["split"]),
        ({"skills_experience": "Python|5,node.js|1"}, ["split"]),
        ({"skills_experience": "Java|1"}, []),
        ({"skills_experience": "text|0"}, []),
        ({"industry_type": "FIN.TECH", "company_size": "<50"}, ["split"]),
        ({"industry_type": "fin-tech"}, []),
        ({"startup_experience": ""}, ALL),
    ],
)
def test_filter(people, params, want):
    assert ids(people, **params) == want


def test_literal(people):
    assert ids(people, literal=True, resume_type="Natural_language_processing_(NLP)_engineer") == ["split"]


@pytest.mark.parametrize(
    "params",
    [
        {"skills_experience": "python"},
        {"skills_experience": "python|1|2"},
        {"skills_experience": "python|x"},
        {"full_time_experience": "many"},
        {"full_time_experience": "nan"},
        {"company_size": "10"},
        {"resume_type": "  "},
    ],
)
def test_refused(params):
    with pytest.raises(FilterError):
        FilterSpec.from_params(params)


def test_time_window_needs_tracking(people):
    with pytest.raises(ValueError):
        retrieve(people, {"time_filter": "one_day"})


@pytest.fixture(scope="module")
def tracking(spark):
    rows = [
        ("1", "A" * 24, "2024-02-29 00:00:00"),
        ("2", "b" * 24, "2024-02-28 23:59:59"),
        ("3", "", "2024-03-30 00:00:00"),
        ("4", "not-an-id", "2024-03-30 00:00:00"),
    ]
    return spark.createDataFrame(rows, "id string, parsed_data_id string, t string").withColumn("modified_at", F.col("t").cast("timestamp"))


def test_time_window(make_profiles, tracking):
    people = make_profiles({"a" * 24: {}, "b" * 24: {}})
    end = "2024-03-31 00:00:00"
    assert [r.profile_id for r in retrieve(people, {"time_filter": "one_month"}, tracking, end).collect()] == ["a" * 24]
    assert retrieve(people, {"time_filter": "two_month"}, tracking, end).count() == 2
    assert retrieve(people, {"time_filter": "one_hour"}, tracking, end).count() == 0


def test_and_narrows_or_widens(spark, sf):
    people = star_store(spark, sf)

    def found(**params):
        return {r.profile_id for r in retrieve(people, params).select("profile_id").collect()}

    a, b = found(skills_and="LARGE"), found(skills_and="Brand#1")
    assert found(skills_and="LARGE,Brand#1") == a & b
    assert found(skills_or="LARGE,Brand#1") == a | b
    assert found(skills_or="LARGE", proficient_technologies_or="Brand#1") >= a
    assert found(skills_and="LARGE", full_time_experience="10") == a & found(full_time_experience="10")


def test_scan_reads_little(spark, sf):
    spec = {"full_time_experience": "5", "skills_and": "LARGE", "degree_type": "masters"}
    plan = retrieve(star_store(spark, sf), spec).select("profile_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(parsed_data.additional_experience_summary.years_of_full_time_experience_after_graduation,5.0)" in plan
    assert "education:array<struct<degree_level:string>>" in plan
    for absent in ("school_name", "company_information", "Python", "proficient:array"):
        assert absent not in plan.split("ReadSchema")[1]


def test_only_a_line_feed_ends_a_pattern_early(make_profiles):
    """The end of a pattern is the end of the value or its last line feed; other line ends are letters like any."""
    ends = {"plain": "masters", "feed": "masters\n", "two": "masters\n\n", "return": "masters\r", "next": "masters\x85", "line": "masters ", "dot": "masters\rx"}
    rows = make_profiles({k: {"education": [{"degree_level": v}]} for k, v in ends.items()})

    def found(pattern):
        return sorted(r.profile_id for r in retrieve(rows, {"degree_type": pattern}).select("profile_id").collect())

    assert found("masters") == ["feed", "plain"]
    assert found("MASTERS.*x") == ["dot"]
