"""Text preparation, contacts and links."""

from pyspark.sql import functions as F

from dossier import constants as K
from dossier.functions import durations, links, text as X
from dossier.operators.contacts import document_links, profile_links
from dossier.operators.pages import assemble_pages, contacts_in_pages, fill_blank_documents
from dossier.workload.registry import query
from dossier.workload.star import table

STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in K.STOP_WORDS) + "]"


def cleaned(text):
    words = f"regexp_split_to_array(lower({text}), '\\s+')"
    return f"array_to_string(list_filter({words}, lambda w: w <> '' AND NOT list_contains({STOP}, w)), ' ')"


EMAIL_SQL = f"nullif(regexp_extract(c, '{K.EMAIL}'), '')"
MOBILE_SQL = "nullif(regexp_extract(c, '(\\+91[-.\\s]?)?([6-9][0-9]{9})\\b', 2), '')"
BLANK = "' ' || chr(9) || chr(10) || chr(13)"
ASSEMBLED = (
    "SELECT conv_id, "
    f"coalesce(trim(string_agg(text, chr(10) ORDER BY turn, text) FILTER (WHERE text <> ''), {BLANK}), '') AS text FROM conversations GROUP BY ALL"
)


@query("page_assembly", ASSEMBLED)
def page_assembly(spark, sf_dir):
    """A turn of a conversation is a page."""
    return assemble_pages(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query(
    "text_fallback",
    f"""WITH first AS (SELECT conv_id, coalesce(string_agg(text, chr(10) ORDER BY turn, text) FILTER (WHERE text <> '' AND turn % 2 = 1), '') AS text
                       FROM conversations GROUP BY conv_id)
        SELECT conv_id, nullif(trim(CASE WHEN trim(f.text, {BLANK}) = '' THEN s.text ELSE f.text END, {BLANK}), '') AS text
        FROM first f LEFT JOIN ({ASSEMBLED}) s USING (conv_id)""",
)
def text_fallback(spark, sf_dir):
    """The first reader sees odd turns only; a conversation that is blank to it is read whole."""
    turns = table(spark, sf_dir, "conversations")
    odd = turns.withColumn("text", F.when(F.col("turn") % 2 == 1, F.col("text")))
    return fill_blank_documents(assemble_pages(odd, "conv_id", "turn"), assemble_pages(turns, "conv_id", "turn"), "conv_id")


@query("clean_text", f"SELECT doc_id, {cleaned('text')} AS text FROM documents")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.clean(F.col("text")).alias("text"))


@query("extract_email", f"WITH c AS (SELECT doc_id, {cleaned('text')} AS c FROM documents) SELECT doc_id, {EMAIL_SQL} AS email FROM c")
def extract_email(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.first_email(F.lower("text")).alias("email"))


@query("extract_mobile", f"WITH c AS (SELECT doc_id, {cleaned('text')} AS c FROM documents) SELECT doc_id, {MOBILE_SQL} AS mobile FROM c")
def extract_mobile(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.first_mobile(F.lower("text")).alias("mobile"))


@query(
    "text_contacts",
    f"""WITH c AS (SELECT conv_id, {cleaned('text')} AS c FROM ({ASSEMBLED}))
        SELECT conv_id, {EMAIL_SQL} AS text_email, {MOBILE_SQL} AS text_mobile, true AS has_text FROM c""",
)
def text_contacts(spark, sf_dir):
    """Pages to the first contacts of each document, against cleaned whole texts."""
    return contacts_in_pages(table(spark, sf_dir, "conversations"), "conv_id", "turn")


# --- mobiles and e-mails written in several ways -------------------------------------------------

_SHAPES = """SELECT c_custkey, CASE c_custkey % 8
    WHEN 0 THEN '+91-' || cast(9000000000 + c_custkey AS STRING)
    WHEN 1 THEN '98765 ' || cast(10000 + c_custkey AS STRING)
    WHEN 2 THEN '5876543210'
    WHEN 3 THEN '12' || cast(c_custkey AS STRING)
    WHEN 4 THEN '7' || cast(100000000000 + c_custkey AS STRING)
    WHEN 5 THEN '(+91) 8' || cast(100000000 + c_custkey AS STRING) || ' ext 5'
    WHEN 6 THEN NULL
    ELSE cast(6000000000 + c_custkey AS STRING) END AS mobile,
  CASE c_custkey % 5
    WHEN 0 THEN 'c' || cast(c_custkey AS STRING) || '@example.com'
    WHEN 1 THEN c_name || '@example.com'
    WHEN 2 THEN 'a b@example.com'
    WHEN 3 THEN NULL
    ELSE c_name END AS email
  FROM customer"""


def _shapes(spark, sf_dir):
    spark_sql = _SHAPES.replace("FROM customer", "FROM {customer}")
    return spark.sql(spark_sql, customer=table(spark, sf_dir, "customer"))


@query(
    "fix_mobile",
    f"""WITH m AS (SELECT c_custkey, mobile, regexp_replace(replace(mobile, '+91', ''), '[^0-9]', '', 'g') AS d FROM ({_SHAPES}))
        SELECT c_custkey, CASE WHEN length(d) >= 10 AND d[1] IN ('6', '7', '8', '9')
          THEN CASE WHEN contains(mobile, '+91') THEN '+91 ' ELSE '' END || substr(d, 1, 10) END AS mobile FROM m""",
)
def fix_mobile(spark, sf_dir):
    return _shapes(spark, sf_dir).select("c_custkey", X.repair_mobile(F.col("mobile")).alias("mobile"))


@query(
    "contact_validity",
    f"""SELECT c_custkey,
          coalesce(regexp_full_match(email, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9.-]+'), false) AS email_ok,
          coalesce(length(regexp_replace(CASE WHEN starts_with(mobile, '+91') THEN substr(mobile, 4) ELSE mobile END, '[^0-9]', '', 'g')) = 10, false) AS mobile_ok
        FROM ({_SHAPES})""",
)
def contact_validity(spark, sf_dir):
    return _shapes(spark, sf_dir).select(
        "c_custkey", X.is_email(F.col("email")).alias("email_ok"), X.is_mobile(F.col("mobile")).alias("mobile_ok")
    )


# --- links ---------------------------------------------------------------------------------------

# another way than a pattern: what stands behind each ' href="' up to the next quote
HREFS_SQL = """list_transform(string_split(html, ' href="')[2:], lambda h: replace(string_split(h, '"')[1], '&amp;', '&'))"""


@query(
    "page_links",
    f"WITH l AS (SELECT page_id, {HREFS_SQL} AS urls FROM pages) "
    "SELECT page_id, (unnest(range(len(urls))))::INTEGER AS pos, unnest(urls) AS url FROM l",
)
def page_links(spark, sf_dir):
    """One row per link, in page order."""
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(links.link_targets(F.col("html"))).alias("pos", "url"))


PICKED = f"""WITH h AS (SELECT page_id, {HREFS_SQL} AS urls FROM pages),
        l AS (SELECT page_id, list_transform(urls, lambda u: 'p' || regexp_replace(u, '[^a-zA-Z0-9]+', '-', 'g')) AS t, len(urls) AS n FROM h), picked AS (
        SELECT page_id,
          CASE WHEN n > 1 THEN 'https://www.linkedin.com/in/' || t[(n - 2) // 4 * 4 + 2] END AS linkedin_url,
          CASE WHEN n > 0 THEN 'http://github.com/' || t[(n - 1) // 4 * 4 + 1] || '/' END AS github_url,
          CASE WHEN n > 3 THEN t[(n - 4) // 4 * 4 + 4] || '@example.org' END AS mailto
        FROM l)"""


def _turned_links(spark, sf_dir):
    """The links of each page turned in rotation into an account, a profile, a repository and an address named by their text."""

    def turned(url, i):
        name = F.concat(F.lit("p"), F.regexp_replace(url, "[^a-zA-Z0-9]+", "-"))
        return (
            F.when(i % 4 == 0, F.concat(F.lit("http://github.com/"), name, F.lit("/")))
            .when(i % 4 == 1, F.concat(F.lit("https://www.linkedin.com/in/"), name))
            .when(i % 4 == 2, F.concat(F.lit("https://github.com/"), name, F.lit("/repository")))
            .otherwise(F.concat(F.lit("mailto:"), name, F.lit("@example.org?subject=x")))
        )

    return table(spark, sf_dir, "pages").withColumn("urls", F.transform(links.link_targets(F.col("html")), turned))


@query("profile_links", f"{PICKED} SELECT page_id, linkedin_url, github_url, mailto FROM picked")
def profile_link_pick(spark, sf_dir):
    return profile_links(_turned_links(spark, sf_dir)).select("page_id", "linkedin_url", "github_url", "mailto")


@query(
    "document_links",
    f"{PICKED} SELECT page_id // 10 AS doc_id, "
    + ", ".join(f"arg_max({k}, page_id) FILTER (WHERE {k} IS NOT NULL) AS {k}" for k in ("linkedin_url", "github_url", "mailto"))
    + " FROM picked GROUP BY 1",
)
def links_of_documents(spark, sf_dir):
    """Ten pages make a document."""
    listed = _turned_links(spark, sf_dir)
    html = F.array_join(F.transform("urls", lambda u: F.concat(F.lit('<a href="'), u, F.lit('">'))), " ")
    pages = listed.select(F.expr("page_id div 10").alias("doc_id"), "page_id", html.alias("html"))
    return document_links(pages, "doc_id", "page_id")


# --- rendering -------------------------------------------------------------------------------------

_YEARS = "CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE (CAST(o_totalprice AS DECIMAL(18,2)) - 250000) / 25000 END"


def duration_sql(value):
    """Years and months of a DOUBLE expression."""
    y = f"trunc(coalesce({value}, 0))::BIGINT"
    m = f"round_even((coalesce({value}, 0) - trunc(coalesce({value}, 0))) * 12, 0)::BIGINT"
    years = f"({y}) || CASE WHEN {y} = 1 THEN ' year' ELSE ' years' END"
    months = f"({m}) || CASE WHEN {m} = 1 THEN ' month' ELSE ' months' END"
    return f"CASE WHEN {y} > 0 AND {m} > 0 THEN {years} || ' ' || {months} WHEN {y} > 0 THEN {years} ELSE {months} END"


@query(
    "fmt_years",
    f"WITH v AS (SELECT o_orderkey, ({_YEARS})::DOUBLE AS v FROM orders) SELECT o_orderkey, {duration_sql('v')} AS duration FROM v",
)
def fmt_years(spark, sf_dir):
    value = F.expr(f"CAST({_YEARS} AS DOUBLE)")
    return table(spark, sf_dir, "orders").select("o_orderkey", durations.years_and_months(value).alias("duration"))


@query("fmt_dates", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS created_at FROM events")
def fmt_dates(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", durations.day(F.col("ts")).alias("created_at"))
