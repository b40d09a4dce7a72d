"""Filters, paging, time windows, lookups and roll-ups."""

from pyspark.sql import functions as F

from dossier.operators import tracking as TR
from dossier.operators.filters import FilterSpec
from dossier.operators.paging import page, page_after
from dossier.plans.retrieval import page_envelope, retrieve
from dossier.workload.registry import query, register
from dossier.workload.star import hex24, star_store, star_tracking, table
from dossier.workload.star_sql import PROFILES, TRACKING

EVERY = "list_concat(lang_p, lang_a, fw_p, fw_a, tech_p, tech_a)"
BEST = "list_concat(lang_p, fw_p, tech_p)"


def _has(skills, skill):
    return f"coalesce(list_contains({skills}, '{skill}'), false)"


def _years(key, years):
    return f"len(list_filter(entries, lambda e: e.skill = '{key}' AND e.years >= {years})) > 0"


def _any(items, test):
    return f"len(list_filter({items}, lambda x: coalesce({test}, false))) > 0"


# name: (parameters as a request brings them, the same test in SQL over the profiles)
FILTERS = {
    "f_full_time": ({"full_time_experience": "20"}, "ft >= 20"),
    "f_full_time_zero": ({"full_time_experience": "0"}, "true"),
    "f_skill_years": (
        {"skills_experience": "Brand#1|5, brand#4|6.5"},
        f"{_years('brand#1', 5)} AND {_years('brand#4', 6.5)}",
    ),
    "f_company_type": ({"company_type": "product"}, "pr > 0"),
    "f_company_type_other": ({"company_type": "service"}, "true"),
    "f_product_exp": ({"product_company_experience": "8.5", "company_type": "product"}, "pr >= 8.5"),
    "f_startup_exp": ({"startup_experience": "4"}, "st >= 4"),
    "f_degree_type": ({"degree_type": "MASTERS|phd"}, _any("education", "regexp_matches(x.lvl, '(?i)^masters|phd$')")),
    "f_last_position": ({"last_position_held": "Not Spec"}, "contains(held, 'not spec')"),
    "f_flags": ({"gen_ai_experience": "True", "llm_experience": "false"}, "gen_ai = true AND llm = false"),
    "f_degree_flags": ({"is_ml_degree": "true", "is_cs_degree": "false"}, f"{_any('education', 'x.ml')} AND {_any('education', 'NOT x.cs')}"),
    "f_early_stage": ({"early_stage_startup_experience": "2.25"}, "es >= 2.25"),
    "f_institute": ({"institute_type": "IIIT"}, _any("education", "x.institute = 'iiit'")),
    "f_institute_all": ({"institute_type": "All"}, _any("education", "x.institute IN ('iit', 'nit', 'iiit', 'bits')")),
    "f_service_exp": ({"service_company_experience": "6"}, "se >= 6"),
    "f_resume_type": ({"resume_type": "MACH.*|build"}, "regexp_matches(resume_type, '(?i)^mach.*|build$')"),
    "f_projects": ({"projects_outside_of_work": "false"}, "len(projects) > 0"),
    "f_skills_and": ({"skills_and": "Brand#1, PROMO,red bolt"}, f"{_has(EVERY, 'Brand#1')} AND {_has(EVERY, 'PROMO')} AND {_has(EVERY, 'red bolt')}"),
    "f_prof_and": ({"proficient_technologies_and": "LARGE,Brand#2"}, f"{_has(BEST, 'LARGE')} AND {_has(BEST, 'Brand#2')}"),
    "f_skills_or": ({"skills_or": "Brand#3,blue gear"}, f"{_has(EVERY, 'Brand#3')} OR {_has(EVERY, 'blue gear')}"),
    "f_or_merge": (
        {"skills_or": "Brand#3", "proficient_technologies_or": "SMALL,hot bolt"},
        f"{_has(EVERY, 'Brand#3')} OR {_has(BEST, 'SMALL')} OR {_has(BEST, 'hot bolt')}",
    ),
    "f_industry": ({"industry_type": "Sector C"}, _any("experience", "x.industry = 'sector c'")),
    "f_company_size": ({"company_size": ">1000"}, _any("experience", "x.size = '>1000'")),
    # the three tests may be met by three different degrees
    "f_independent_elements": (
        {"degree_type": "masters", "is_ml_degree": "true", "institute_type": "nit"},
        f"{_any('education', 'x.lvl = ' + chr(39) + 'masters' + chr(39))} AND {_any('education', 'x.ml')} AND {_any('education', 'x.institute = ' + chr(39) + 'nit' + chr(39))}",
    ),
    "f_combined": (
        {
            "skills_and": "LARGE",
            "skills_or": "Brand#1,Brand#2,Brand#3",
            "full_time_experience": "10",
            "resume_type": "building|machinery|furniture",
            "is_cs_degree": "true",
            "projects_outside_of_work": "yes",
            "company_size": "50-200",
            "format_type": "csv",
            "unknown": "ignored",
        },
        f"{_has(EVERY, 'LARGE')} AND ({_has(EVERY, 'Brand#1')} OR {_has(EVERY, 'Brand#2')} OR {_has(EVERY, 'Brand#3')}) AND ft >= 10 "
        f"AND regexp_matches(resume_type, '(?i)^building|machinery|furniture$') AND {_any('education', 'x.cs')} AND len(projects) > 0 "
        f"AND {_any('experience', 'x.size = ' + chr(39) + '50-200' + chr(39))}",
    ),
}


def _shown(profiles):
    return profiles.select(
        "profile_id", F.col("parsed_data.personal_information.name").alias("name"), F.col("parsed_data.resume_type").alias("resume_type")
    )


def _filter(params):
    return lambda spark, sf_dir: _shown(retrieve(star_store(spark, sf_dir), params))


for _name, (_params, _test) in FILTERS.items():
    register(_name, _filter(_params), f"WITH {PROFILES} SELECT profile_id, name, resume_type FROM profiles WHERE {_test}")


# --- time windows ------------------------------------------------------------------------------

# Each window ends so that it begins shortly before the last events, at another hour for each: a window
# of another length then finds other profiles.
_WINDOWS = {
    "one_hour": ("1 HOUR", "2024-01-31 00:00:00"),
    "six_hour": ("6 HOUR", "2024-01-31 03:00:00"),
    "tweleve_hour": ("12 HOUR", "2024-01-31 07:00:00"),
    "one_day": ("1 DAY", "2024-01-31 16:00:00"),
    "one_week": ("7 DAY", "2024-02-06 13:00:00"),
    "two_week": ("14 DAY", "2024-02-13 11:00:00"),
    "three_week": ("21 DAY", "2024-02-20 09:00:00"),
    "forty_five_days": ("45 DAY", "2024-03-15 06:00:00"),
    "one_month": ("1 MONTH", "2024-02-29 20:00:00"),
    "two_month": ("2 MONTH", "2024-03-30 18:30:00"),
    "three_month": ("3 MONTH", "2024-04-30 15:30:00"),
}


def _window(name, end):
    def build(spark, sf_dir):
        found = retrieve(star_store(spark, sf_dir), {"time_filter": name}, star_tracking(spark, sf_dir), end)
        return found.select("profile_id")

    return build


for _name, (_length, _end) in _WINDOWS.items():
    register(
        "time_filter" if _name == "one_day" else f"time_filter_{_name}",
        _window(_name, _end),
        f"WITH {PROFILES}, {TRACKING} SELECT profile_id FROM profiles WHERE profile_id IN "
        f"(SELECT parsed_data_id FROM tracking WHERE modified_at >= TIMESTAMP '{_end}' - INTERVAL {_length})",
    )


@query(
    "time_filter_combined",
    f"WITH {PROFILES}, {TRACKING} SELECT profile_id, name, resume_type FROM profiles WHERE {_has(EVERY, 'LARGE')} AND profile_id IN "
    f"(SELECT parsed_data_id FROM tracking WHERE modified_at >= TIMESTAMP '2024-01-12 10:00:00' - INTERVAL 1 DAY)",
)
def time_filter_combined(spark, sf_dir):
    params = {"time_filter": "one_day", "skills_and": "LARGE"}
    return _shown(retrieve(star_store(spark, sf_dir), params, star_tracking(spark, sf_dir), "2024-01-12 10:00:00"))


# --- pages and counts --------------------------------------------------------------------------

_PAGED = {"skills_and": "LARGE", "full_time_experience": "10"}
_PAGED_SQL = f"{_has(EVERY, 'LARGE')} AND ft >= 10"


@query("page", f"WITH {PROFILES} SELECT profile_id, name, resume_type FROM profiles WHERE {_PAGED_SQL} ORDER BY profile_id LIMIT 100 OFFSET 100")
def second_page(spark, sf_dir):
    """Candidates with a skill and at least ten years, page 2."""
    return _shown(page(retrieve(star_store(spark, sf_dir), _PAGED), number=2))


@query("page_deep", f"WITH {PROFILES} SELECT profile_id, name, resume_type FROM profiles ORDER BY profile_id LIMIT 10 OFFSET 80")
def ninth_page(spark, sf_dir):
    """Of all profiles."""
    return _shown(page(star_store(spark, sf_dir), number=9, limit=10))


@query(
    "page_last",
    f"WITH {PROFILES}, found AS (SELECT profile_id, name, resume_type FROM profiles WHERE {_PAGED_SQL}) "
    "SELECT * FROM found ORDER BY profile_id OFFSET (SELECT greatest(ceil(count(*) / 40.0) - 1, 0)::BIGINT * 40 FROM found)",
)
def last_page(spark, sf_dir):
    return _shown(page(retrieve(star_store(spark, sf_dir), _PAGED), number="last", limit=40))


@query(
    "page_after",
    f"WITH {PROFILES} SELECT profile_id, name, resume_type FROM profiles WHERE {_PAGED_SQL} AND profile_id > '0000000000000000000001f4' ORDER BY profile_id LIMIT 1000",
)
def next_page(spark, sf_dir):
    return _shown(page_after(retrieve(star_store(spark, sf_dir), _PAGED), hex_id(500), limit=5000))


def hex_id(k):
    return f"{k:024x}"


@query(
    "result_count",
    f"WITH {PROFILES}, n AS (SELECT count(*) AS count FROM profiles WHERE {_PAGED_SQL}) "
    "SELECT count, (CASE WHEN count > 200 THEN 3 END)::INTEGER AS next_page, (CASE WHEN count > 0 THEN 1 END)::INTEGER AS previous_page FROM n",
)
def result_count(spark, sf_dir):
    return page_envelope(star_store(spark, sf_dir), _PAGED, number=2)


# --- tracking table ----------------------------------------------------------------------------


@query("categories", f"WITH {TRACKING} SELECT DISTINCT resume_category FROM tracking")
def categories(spark, sf_dir):
    return TR.distinct_categories(star_tracking(spark, sf_dir))


@query("profile_categories", f"WITH {PROFILES} SELECT profile_id, resume_type AS resume_category FROM profiles")
def profile_categories(spark, sf_dir):
    return star_store(spark, sf_dir).select("profile_id", F.col("parsed_data.resume_type").alias("resume_category"))


@query(
    "tracking_since",
    f"WITH {TRACKING} SELECT DISTINCT parsed_data_id AS profile_id FROM tracking WHERE modified_at >= TIMESTAMP '2024-01-30 12:00:00' AND parsed_data_id <> ''",
)
def tracking_since(spark, sf_dir):
    return TR.modified_since(star_tracking(spark, sf_dir), F.lit("2024-01-30 12:00:00").cast("timestamp"))


@query(
    "lookup_ids",
    f"WITH {TRACKING} SELECT id, resume_category, parsing_status FROM tracking WHERE id IN (SELECT c_custkey::VARCHAR FROM customer)",
)
def lookup_ids(spark, sf_dir):
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    return TR.by_ids(star_tracking(spark, sf_dir), ids).select("id", "resume_category", "parsing_status")


@query("lookup_id", f"WITH {TRACKING} SELECT id, resume_category, parsing_status FROM tracking WHERE id = '42'")
def lookup_id(spark, sf_dir):
    return TR.by_id(star_tracking(spark, sf_dir), "42").select("id", "resume_category", "parsing_status")


_ROLLUP = "count(*) AS documents, count(*) FILTER (WHERE no_of_retries > 0) AS retried, sum(no_of_retries)::BIGINT AS retries"


@query(
    "status_rollup",
    f"WITH {TRACKING} SELECT CASE WHEN no_of_retries >= 3 AND parsing_status = 'in_progress' THEN 'failed' ELSE parsing_status END AS parsing_status, "
    f"{_ROLLUP} FROM tracking GROUP BY 1",
)
def status_rollup(spark, sf_dir):
    return TR.status_rollup(TR.mark_failed(star_tracking(spark, sf_dir)))


@query(
    "intake",
    """SELECT regexp_replace(substr(sha256(file || '|1706745600000000|1'), 1, 32), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS id,
         file, 'in_progress' AS parsing_status, 0 AS no_of_retries, '' AS parsed_data_id, '2024-02-01' AS created
       FROM (SELECT source || '/' || doc_id AS file FROM documents)""",
)
def intake(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file"))
    rows = TR.intake(files, "2024-02-01 00:00:00")
    return rows.select("id", "file", "parsing_status", "no_of_retries", "parsed_data_id", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


@query(
    "tracking_update",
    f"""WITH {TRACKING}, log AS (
          SELECT o_custkey::VARCHAR AS id, o_orderkey AS seq, o_orderdate AS moment,
            CASE o_orderpriority WHEN '1-URGENT' THEN 'failed' WHEN '2-HIGH' THEN 'completed' END AS st,
            CASE WHEN o_orderstatus = 'F' THEN lower(o_orderpriority) END AS cat FROM orders),
        last AS (SELECT id, arg_max(st, seq) FILTER (WHERE st IS NOT NULL) AS st, arg_max(cat, seq) FILTER (WHERE cat IS NOT NULL) AS cat,
            max(moment) FILTER (WHERE st IS NOT NULL OR cat IS NOT NULL) AS moment FROM log GROUP BY id)
        SELECT t.id, coalesce(st, parsing_status) AS parsing_status, coalesce(cat, resume_category) AS resume_category,
          parsed_data_id, no_of_retries, strftime(coalesce(moment, modified_at), '%Y-%m-%d %H:%M:%S') AS modified_at
        FROM tracking t LEFT JOIN last USING (id)""",
)
def tracking_update(spark, sf_dir):
    log = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("id"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_orderdate").alias("at"),
        F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 'failed' WHEN '2-HIGH' THEN 'completed' END").alias("parsing_status"),
        F.when(F.col("o_orderstatus") == "F", F.lower("o_orderpriority")).alias("resume_category"),
    )
    updated = TR.apply_updates(star_tracking(spark, sf_dir), log)
    return updated.select(
        "id", "parsing_status", "resume_category", "parsed_data_id", "no_of_retries", F.date_format("modified_at", "yyyy-MM-dd HH:mm:ss").alias("modified_at")
    )


@query(
    "retry_count",
    f"""WITH {TRACKING}, log AS (SELECT l_orderkey::VARCHAR AS id, count(*) AS n FROM lineitem GROUP BY 1),
        counted AS (SELECT id, parsing_status, (no_of_retries + coalesce(n, 0))::INTEGER AS no_of_retries FROM tracking LEFT JOIN log USING (id))
        SELECT id, no_of_retries, CASE WHEN no_of_retries >= 3 AND parsing_status = 'in_progress' THEN 'failed' ELSE parsing_status END AS parsing_status
        FROM counted""",
)
def retry_count(spark, sf_dir):
    retries = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("id"))
    return TR.mark_failed(TR.count_retries(star_tracking(spark, sf_dir), retries)).select("id", "no_of_retries", "parsing_status")


@query(
    "link_ids",
    """SELECT o_orderkey::VARCHAR AS id, lpad(lower(to_hex(c_custkey)), 24, '0') AS parsed_data_id
       FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND o_orderpriority <> '5-LOW'""",
)
def link_ids(spark, sf_dir):
    uploads = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.concat(F.lit("c"), "o_custkey", F.lit("@example.com"))).alias("email"),
    )
    profiles = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), "c_custkey", F.lit("@example.com")).alias("email"), hex24(F.col("c_custkey")).alias("profile_id")
    )
    return TR.link_profiles(uploads, profiles).select("id", "parsed_data_id")


def flagship(spark, sf_dir):
    """Candidates with both skills and at least ten years, first page."""
    spec = FilterSpec(skills_and="LARGE,Brand#1", full_time_experience=10.0)
    return _shown(page(retrieve(star_store(spark, sf_dir), spec)))


register(
    "candidates",
    flagship,
    f"WITH {PROFILES} SELECT profile_id, name, resume_type FROM profiles WHERE {_has(EVERY, 'LARGE')} AND {_has(EVERY, 'Brand#1')} AND ft >= 10 "
    "ORDER BY profile_id LIMIT 100",
)
