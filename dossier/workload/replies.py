"""Documents with replies derived from the customers, defects included.

Which customer has which defect depends on the key alone, so the checking SQL can state the
expected outcome without parsing anything.
"""

from pyspark.sql import functions as F

from dossier.operators.hotkeys import spread
from dossier.workload.star import table

BODY = """'{"personal_information": ' || CASE WHEN k % 41 = 20 THEN 'null' ELSE
     '{"name": "' || c_name || '", "email": ' || CASE k % 12 WHEN 1 THEN 'null' WHEN 2 THEN '""' ELSE '"C' || k || '@Example.com"' END
     || ', "mobile": ' || CASE k % 4 WHEN 0 THEN '' || (9000000000 + k) WHEN 1 THEN '"+91-' || (9000000000 + k) || '"' WHEN 2 THEN '"98 12"' ELSE '"0' || (9000000000 + k) || '"' END
     || ', "city": "Town ' || c_nationkey || '", "age": "0' || (k % 90) || '"}' END
  || ', "resume_type": "' || c_mktsegment || '", "title": "' || CASE WHEN k % 3 = 0 THEN ' 00' || k || ' ' ELSE 'Title ' || k END
  || '", "skills": {"languages": ' || CASE WHEN k % 19 = 4 THEN 'null' ELSE '{"proficient": ["Go", " SQL "' || CASE WHEN k % 5 = 4 THEN ', "C", "D"' ELSE '' END || '], "average": ["Java"]}' END
  || ', "frameworks": {"proficient": ["Spark"], "average": []}, "total_skill_experience": {"Zeta": ' || (k % 20) || ', "alpha": "2.5", "node.js": "0' || (k % 10)
  || '", "beta": 1.5, "gamma": true}, "llm_experience": ' || CASE WHEN k % 9 = 2 THEN 'null' WHEN k % 2 = 0 THEN 'true' ELSE 'false' END
  || ', "gen_ai_experience": "' || CASE WHEN k % 10 = 7 THEN ' ' ELSE 'False' END
  || '"}, "education": [{"school_name": "School ' || c_nationkey || '", "year_of_start": ' || CASE WHEN k % 8 = 5 THEN '"two thousand"' WHEN k % 8 = 4 THEN '"' || (2000 + k % 15) || '"' ELSE '' || (2000 + k % 15) END
  || ', "year_of_graduation": 2014.0, "is_cs_degree": ' || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END
  || ', "is_ml_degree": "False", "hobby": 1}], "experience": [{"company_information": {"name": "Firm ' || (k % 100) || '", "total_duration_in_years": "' || (k % 7)
  || '.5", "company_size_range": "' || CASE k % 3 WHEN 0 THEN '>50' WHEN 1 THEN '1000<' ELSE '50-200' END
  || '", "is_faang": false, "is_startup": "TRUE"}, "positions_held_within_the_company": [{"position_name": "Dev ' || c_nationkey
  || '"}]}], "projects_outside_of_work": [], "additional_experience_summary": {"product_company_experience": ' || (k % 6)
  || ', "service_company_experience": "' || (k % 4) || '", "total_startup_experience": "2.5", "gen_ai_experience": true}, "overall_summary_of_candidate": "SUM ' || k || '"}'"""

CONTENT = """CASE WHEN k % 31 = 11 THEN NULL WHEN k % 23 = 9 THEN 'no json here {' WHEN k % 29 = 10 THEN '[1, 2]' WHEN k % 37 = 14 THEN body || ' Done.'
  WHEN k % 7 = 3 THEN replace(body, '"average": []}', '"average": [ ] , }')
  WHEN k % 11 = 5 THEN replace(body, '"', '''')
  WHEN k % 13 = 6 THEN regexp_replace(body, '"(\\\\w+)":', '$1:')
  WHEN k % 17 = 8 THEN substring(body, 2, length(body) - 2)
  ELSE body END"""

# the content in the other dialect
CONTENT_SQL = CONTENT.replace(r"""regexp_replace(body, '"(\\w+)":', '$1:')""", r"""regexp_replace(body, '"(\w+)":', '\1:', 'g')""")

# the same, told as the outcome that has to be found
STATE = """CASE WHEN k % 31 = 11 OR k % 23 = 9 THEN 'bad' WHEN k % 29 = 10 THEN 'list' WHEN k % 37 = 14 THEN 'bad'
  WHEN k % 7 = 3 OR k % 11 = 5 OR k % 13 = 6 OR k % 17 = 8 THEN 'repaired' ELSE 'ok' END"""
EXPECTED = f"""
told AS (SELECT c_custkey AS k, *, {STATE} AS state FROM customer),
expected AS (
  SELECT *, state IN ('ok', 'repaired') AS is_object,
    CASE state WHEN 'bad' THEN ['syntax:$'] WHEN 'list' THEN ['type:$'] ELSE list_filter([
      CASE WHEN k % 10 = 7 THEN 'blank:skills.gen_ai_experience' END,
      CASE WHEN k % 19 = 4 THEN 'null:skills.languages' END,
      CASE WHEN k % 9 = 2 THEN 'null:skills.llm_experience' END,
      CASE WHEN k % 5 = 4 AND k % 19 <> 4 THEN 'too_many:skills.languages.proficient' END,
      CASE WHEN k % 8 = 5 THEN 'type:education[].year_of_start' END], lambda r: r IS NOT NULL) END AS errors,
    CASE WHEN k % 41 = 20 OR k % 12 = 1 THEN NULL WHEN k % 12 = 2 THEN '' ELSE 'c' || k || '@example.com' END AS own_email,
    CASE WHEN k % 41 = 20 THEN NULL WHEN k % 4 = 1 THEN '+91-' || (9000000000 + k) WHEN k % 4 = 2 THEN '98 12' ELSE '' || (9000000000 + k) END AS own_mobile,
    CASE WHEN k % 3 = 0 THEN '' || k ELSE 'title ' || k END AS title
  FROM told),
merged AS (
  SELECT *, CASE WHEN k % 6 = 0 THEN 'https://www.linkedin.com/in/cand-' || k END AS linkedin,
    CASE WHEN k % 6 = 1 THEN 'https://github.com/cand-' || k END AS github,
    CASE WHEN k % 4 = 3 THEN 'link' || k || '@mail.org' WHEN k % 3 = 1 AND k % 37 <> 12 THEN 'shared' || (k % 50) || '@mail.com' ELSE own_email END AS email,
    CASE WHEN k % 5 = 2 AND k % 37 <> 12 THEN '7' || lpad('' || k, 9, '0') WHEN k % 4 = 1 THEN '+91 ' || (9000000000 + k) WHEN k % 4 = 2 THEN NULL ELSE own_mobile END AS mobile
  FROM expected),
outcome AS (
  SELECT *, CASE WHEN k % 37 = 12 THEN 'extraction' WHEN len(errors) > 0 THEN 'parsing'
      WHEN k % 41 = 20 OR coalesce(email, '') = '' OR mobile IS NULL THEN 'saving' END AS error_class,
    CASE WHEN k % 37 = 12 THEN 'no_text' WHEN len(errors) > 0 THEN array_to_string(errors, ';')
      WHEN k % 41 = 20 THEN 'contacts_missing' WHEN coalesce(email, '') = '' THEN 'email_missing' WHEN mobile IS NULL THEN 'mobile_missing' ELSE '' END AS reasons
  FROM merged)
"""


def documents(spark, sf_dir):
    """``doc_id``, ``seq``, ``text``, ``urls``, ``reply`` and the bare ``body`` of the reply."""
    base = spread(table(spark, sf_dir, "customer")).withColumn("k", F.col("c_custkey"))
    df = base.withColumn("body", F.expr(BODY)).withColumn("broken", F.expr(CONTENT))
    fenced = F.when(F.col("k") % 2 == 0, F.concat(F.lit("```json\n"), "broken", F.lit("\n```"))).otherwise(F.col("broken"))
    reply = F.to_json(F.struct(F.array(F.struct(F.struct(fenced.alias("content")).alias("message"))).alias("choices")))
    text = """CASE WHEN k % 37 = 12 THEN ' \\n ' ELSE 'Profile of ' || c_name || ', mail ' ||
      CASE WHEN k % 3 = 1 THEN 'SHARED' || (k % 50) || '@Mail.com' ELSE 'none' END || '\\n the phone ' ||
      CASE WHEN k % 5 = 2 THEN '+91 7' || lpad(cast(k AS string), 9, '0') ELSE 'none' END END"""
    urls = """array_compact(array('https://example.com/in/x', CASE WHEN k % 6 = 0 THEN 'https://www.linkedin.com/in/cand-' || k END,
      CASE WHEN k % 6 = 1 THEN 'https://github.com/cand-' || k END, 'https://github.com/cand/work', CASE WHEN k % 4 = 3 THEN 'mailto:link' || k || '@mail.org' END))"""
    return df.select(
        F.col("k").cast("string").alias("doc_id"), F.col("k").alias("seq"), F.expr(text).alias("text"), F.expr(urls).alias("urls"), reply.alias("reply"), "body"
    )
