"""Replies: unwrapping, parsing, repair, normalisation, checks, contacts, quarantine, upsert and ingestion."""

import hashlib
import itertools

from pyspark.sql import functions as F

from dossier import constants as K
from dossier import schema
from dossier.functions import conform as C
from dossier.operators.contacts import contact_gate, merge_contacts, profile_links
from dossier.operators.hotkeys import spread
from dossier.operators.profiles import conform, parse_content, unwrap_replies
from dossier.operators.upsert import latest_by_key, merge_latest
from dossier.plans.etl import gather, process, quarantined, read_outcome, write_outcome
from dossier.sources.store import ProfileStore, profile_key
from dossier.sources.tracking_store import TrackingStore, keyed_log
from dossier.sources.uploads import clean_up, listed, take_in
from dossier.streaming.ingest import DOCUMENT, apply_batch, ingest, with_text_contacts
from dossier.streaming.parts import PAGES, REPLIES, WEB_PAGES, ingest_parts
from dossier.workload.registry import query
from dossier.workload.replies import BODY, CONTENT_SQL, EXPECTED, documents
from dossier.workload.star import table, work_folder
from dossier.workload.text_queries import ASSEMBLED, EMAIL_SQL, MOBILE_SQL, cleaned

_runs = itertools.count()


def _number():
    return F.col("doc_id").cast("bigint").alias("c_custkey")


def _parsed(spark, sf_dir):
    return parse_content(unwrap_replies(documents(spark, sf_dir)))


def _conformed(spark, sf_dir):
    return conform(_parsed(spark, sf_dir))


@query(
    "reply_unwrap",
    f"""WITH told AS (SELECT c_custkey AS k, * FROM customer), bodies AS (SELECT k, {BODY} AS body FROM told)
        SELECT k AS c_custkey, md5({CONTENT_SQL}) AS content FROM bodies""",
)
def reply_unwrap(spark, sf_dir):
    """The whole content behind envelope and fences, by its digest."""
    return unwrap_replies(documents(spark, sf_dir)).select(_number(), F.md5("content").alias("content"))


@query(
    "json_parse",
    "SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, event_type <> 'error' AS valid FROM events",
)
def json_parse(spark, sf_dir):
    """Properties of the events; those of errors have something behind the document, which makes it none."""
    text = F.when(F.col("event_type") == "error", F.concat("props", F.lit(" rest"))).otherwise(F.col("props"))
    events = parse_content(table(spark, sf_dir, "events").withColumn("content", text))
    return events.select("event_id", F.try_variant_get("document", "$.k", "bigint").alias("k"), F.col("document").isNotNull().alias("valid"))


@query(
    "json_repair",
    f"WITH {EXPECTED} SELECT k AS c_custkey, state <> 'bad' AS parsed, state = 'repaired' AS repaired, "
    "CASE WHEN is_object THEN 'SUM ' || k END AS overall FROM expected",
)
def json_repair(spark, sf_dir):
    return _parsed(spark, sf_dir).select(
        _number(),
        F.col("document").isNotNull().alias("parsed"),
        "repaired",
        F.try_variant_get("document", "$.overall_summary_of_candidate", "string").alias("overall"),
    )


@query(
    "normalise_values",
    """WITH kv AS (SELECT c_custkey, k, v FROM (SELECT c_custkey, c_custkey % 20 AS z, c_custkey % 10 AS d FROM customer),
          LATERAL (VALUES ('Zeta', '' || z), ('alpha', '"2.5"'), ('node.js', '' || d), ('beta', '1.5'), ('gamma', '"true"')) t(k, v))
        SELECT c_custkey, k AS key, v AS json_value FROM kv""",
)
def normalise_values(spark, sf_dir):
    """The free experience map: digits become numbers, truth values text, 2.5 and "2.5" stay apart, keys stay."""
    entries = F.from_json("body", "skills struct<total_skill_experience map<string,variant>>")["skills"]["total_skill_experience"]
    return documents(spark, sf_dir).select(_number(), F.explode(C.normalised(entries)).alias("key", "json_value"))


@query(
    "normalise_nested",
    """SELECT c_custkey, key, CASE key WHEN 'Tags' THEN '["Ab",' || c_custkey || ',"007"]' ELSE
          '{"B":"xy ' || c_custkey || '","list":["Keep",{"Deep":{"Up":"low ' || lower(c_mktsegment) || '","flag":"true"}},[{"Stay":"SAME"}]],"n":' || c_custkey || '}' END AS json_value
        FROM customer, (VALUES ('Age'), ('Tags')) t(key)""",
)
def normalise_nested(spark, sf_dir):
    """Three levels of objects in lists in objects: values change at any depth, plain elements and lists in lists do not."""
    document = """'{"Age": {"B": "XY ' || c_custkey || '", "n": "00' || c_custkey || '", "list": ["Keep", {"Deep": {"Up": "LOW ' || c_mktsegment
        || '", "flag": true}}, [{"Stay": "SAME"}]]}, "Tags": ["Ab", ' || c_custkey || ', "007"]}'"""
    entries = F.from_json(F.expr(document), "map<string,variant>")
    return spread(table(spark, sf_dir, "customer")).select("c_custkey", F.explode(C.normalised(entries)).alias("key", "json_value"))


@query(
    "conform",
    f"""WITH {EXPECTED} SELECT k AS c_custkey,
          CASE WHEN is_object AND k % 41 <> 20 THEN lower(c_name) END AS name,
          CASE WHEN is_object THEN own_email END AS email, CASE WHEN is_object THEN own_mobile END AS mobile,
          CASE WHEN is_object AND k % 41 <> 20 THEN '' || (k % 90) END AS age,
          CASE WHEN is_object THEN lower(c_mktsegment) END AS resume_type, CASE WHEN is_object THEN title END AS title,
          CASE WHEN is_object AND k % 19 <> 4 THEN CASE WHEN k % 5 = 4 THEN 'Go,SQL,C,D' ELSE 'Go,SQL' END END AS languages,
          CASE WHEN is_object THEN 'Zeta,alpha,node.js,beta,gamma' END AS skill_order,
          CASE WHEN is_object THEN (k % 20)::DOUBLE END AS zeta, CASE WHEN is_object THEN (k % 10)::DOUBLE END AS node,
          CASE WHEN is_object THEN false END AS alpha_is_number,
          CASE WHEN is_object AND k % 9 <> 2 THEN k % 2 = 0 END AS llm, CASE WHEN is_object AND k % 10 <> 7 THEN false END AS gen_ai,
          CASE WHEN is_object AND k % 8 <> 5 THEN (2000 + k % 15)::INTEGER END AS start_year, CASE WHEN is_object THEN 2014 END AS end_year,
          CASE WHEN is_object THEN k % 2 = 0 END AS is_cs, CASE WHEN is_object THEN false END AS is_ml,
          CASE WHEN is_object THEN 'firm ' || (k % 100) END AS company, CASE WHEN is_object THEN (k % 7) + 0.5::DOUBLE END AS duration,
          CASE WHEN is_object THEN CASE k % 3 WHEN 0 THEN '<50' WHEN 1 THEN '>1000' ELSE '50-200' END END AS size,
          CASE WHEN is_object THEN true END AS startup, CASE WHEN is_object THEN 'dev ' || c_nationkey END AS position,
          CASE WHEN is_object THEN (k % 6)::DOUBLE END AS product, CASE WHEN is_object THEN (k % 4)::DOUBLE END AS service,
          NULL::DOUBLE AS startup_years, CASE WHEN is_object THEN 'sum ' || k END AS overall
        FROM expected""",
)
def conformed(spark, sf_dir):
    d = F.col("parsed_data")
    study, job = F.get(d["education"], F.lit(0)), F.get(d["experience"], F.lit(0))
    company, years = job["company_information"], d["skills"]["total_skill_experience"]
    summary = d["additional_experience_summary"]
    return _conformed(spark, sf_dir).select(
        _number(),
        d["personal_information"]["name"].alias("name"),
        d["personal_information"]["email"].alias("email"),
        d["personal_information"]["mobile"].alias("mobile"),
        F.try_element_at("other_contacts", F.lit("age")).alias("age"),
        d["resume_type"].alias("resume_type"),
        d["title"].alias("title"),
        F.array_join(d["skills"]["languages"]["proficient"], ",").alias("languages"),
        F.array_join(d["skills"]["skill_entries"]["skill"], ",").alias("skill_order"),
        F.try_element_at(years, F.lit("Zeta")).alias("zeta"),
        F.try_element_at(years, F.lit("node.js")).alias("node"),
        F.when(years.isNotNull(), F.try_element_at(years, F.lit("alpha")).isNotNull()).alias("alpha_is_number"),
        d["skills"]["llm_experience"].alias("llm"),
        d["skills"]["gen_ai_experience"].alias("gen_ai"),
        study["year_of_start"].alias("start_year"),
        study["year_of_graduation"].alias("end_year"),
        study["is_cs_degree"].alias("is_cs"),
        study["is_ml_degree"].alias("is_ml"),
        company["name"].alias("company"),
        company["total_duration_in_years"].alias("duration"),
        company["company_size_range"].alias("size"),
        company["is_startup"].alias("startup"),
        F.get(job["positions_held_within_the_company"], F.lit(0))["position_name"].alias("position"),
        summary["product_company_experience"].alias("product"),
        summary["service_company_experience"].alias("service"),
        summary["total_startup_experience"].alias("startup_years"),
        d["overall_summary_of_candidate"].alias("overall"),
    )


@query(
    "validate_profiles",
    f"WITH {EXPECTED} SELECT k AS c_custkey, array_to_string(errors, ';') AS reasons, len(errors) = 0 AS accepted FROM expected",
)
def validate_profiles(spark, sf_dir):
    return _conformed(spark, sf_dir).select(
        _number(), F.array_join("errors", ";").alias("reasons"), (F.size("errors") == 0).alias("accepted")
    )


@query(
    "contact_merge",
    f"""WITH {EXPECTED} SELECT k AS c_custkey, {", ".join(f"CASE WHEN is_object AND k % 41 <> 20 THEN {c} END AS {c}" for c in ("email", "mobile", "linkedin", "github"))}
        FROM merged""",
)
def contact_merge(spark, sf_dir):
    merged = merge_contacts(profile_links(with_text_contacts(_conformed(spark, sf_dir))))
    own = F.col("parsed_data.personal_information")
    return merged.select(_number(), *[own[c].alias(c) for c in ("email", "mobile", "linkedin", "github")])


@query(
    "contact_gate",
    f"""WITH {EXPECTED} SELECT k AS c_custkey, CASE WHEN NOT is_object OR k % 41 = 20 THEN 'contacts_missing'
          WHEN coalesce(email, '') = '' THEN 'email_missing' WHEN mobile IS NULL THEN 'mobile_missing' END AS gate_error FROM merged""",
)
def gate(spark, sf_dir):
    return contact_gate(merge_contacts(profile_links(with_text_contacts(_conformed(spark, sf_dir))))).select(_number(), "gate_error")


@query(
    "quarantine",
    f"WITH {EXPECTED} SELECT k AS c_custkey, error_class, reasons FROM outcome WHERE error_class IS NOT NULL",
)
def quarantine(spark, sf_dir):
    """What the outcome table holds beside the accepted profiles."""
    path = work_folder(spark, sf_dir, f"outcome-{next(_runs)}")
    write_outcome(process(with_text_contacts(documents(spark, sf_dir))), path)
    return quarantined(read_outcome(spark, path)).select(_number(), "error_class", F.array_join("errors", ";").alias("reasons"))


# --- upsert ----------------------------------------------------------------------------------------


@query(
    "upsert_latest",
    """SELECT 'u' || user_id || '@example.com' AS email, lpad(lower(to_hex(first(event_id ORDER BY ts, event_id))), 24, '0') AS profile_id,
         first(value ORDER BY ts DESC, event_id DESC) AS value, first(event_type ORDER BY ts DESC, event_id DESC) AS event_type
       FROM events WHERE event_type <> 'error' GROUP BY user_id""",
)
def upsert_latest(spark, sf_dir):
    """Events as a batch: the first id of a user is kept, the last payload counts, rows without a key are left out."""
    batch = _events(spark, sf_dir)
    return latest_by_key(batch, "email", "seq", first=["profile_id"], last=["value", "event_type"])


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.when(F.col("event_type") != "error", F.concat(F.lit("u"), "user_id", F.lit("@example.com"))).alias("email"),
        F.lpad(F.lower(F.hex("event_id")), 24, "0").alias("profile_id"),
        F.struct("ts", "event_id").alias("seq"),
        "value",
        "event_type",
        "ts",
    )


@query(
    "upsert_store",
    """SELECT 'u' || user_id || '@example.com' AS email,
         lpad(lower(to_hex(first(event_id ORDER BY event_id % 2, ts, event_id))), 24, '0') AS profile_id,
         first(value ORDER BY ts DESC, event_id DESC) AS value
       FROM events WHERE event_type <> 'error' GROUP BY user_id""",
)
def upsert_store(spark, sf_dir):
    """Odd events into a store made of even ones: a stored id stays, the newer payload wins wherever it comes from."""
    events = _events(spark, sf_dir).withColumn("odd", F.col("seq.event_id") % 2)

    def latest(odd):
        return latest_by_key(events.where(F.col("odd") == odd), "email", "seq", ["profile_id"], ["seq", "value"])

    return merge_latest(latest(0), latest(1), "email", "seq", ["profile_id"], ["value"]).select("email", "profile_id", "value")


@query(
    "page_profiles",
    f"""WITH {EXPECTED}, c AS (SELECT conv_id, {cleaned('text')} AS c FROM ({ASSEMBLED})),
          t AS (SELECT conv_id, {EMAIL_SQL} AS text_email, {MOBILE_SQL} AS text_mobile FROM c),
          own AS (SELECT expected.*, t.conv_id IS NOT NULL AS has_text, coalesce(text_email, own_email) AS email,
              coalesce(text_mobile, CASE WHEN k % 4 = 1 THEN '+91 ' || (9000000000 + k) WHEN k % 4 = 2 THEN NULL ELSE own_mobile END) AS mobile
            FROM expected LEFT JOIN t ON conv_id = k)
        SELECT k AS c_custkey, CASE WHEN NOT has_text THEN 'extraction' WHEN len(errors) > 0 THEN 'parsing'
            WHEN k % 41 = 20 OR coalesce(email, '') = '' OR mobile IS NULL THEN 'saving' ELSE 'none' END AS error_class,
          CASE WHEN is_object AND k % 41 <> 20 THEN email END AS email, CASE WHEN is_object AND k % 41 <> 20 THEN mobile END AS mobile
        FROM own""",
)
def page_profiles(spark, sf_dir):
    """From turns and web pages to outcomes: a conversation is the document of the customer of that number."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").alias("page"), "text")
    web = table(spark, sf_dir, "pages").select(F.expr("cast(page_id div 10 AS string)").alias("doc_id"), F.col("page_id").alias("page"), "html")
    replies = documents(spark, sf_dir).select("doc_id", "seq", "reply")
    own = F.col("parsed_data.personal_information")
    return process(gather(turns, web, replies)).select(_number(), "error_class", own["email"].alias("email"), own["mobile"].alias("mobile"))


@query(
    "store_lookup",
    """SELECT 'c' || c_custkey || '@example.com' AS email, substr(sha256('c' || c_custkey || '@example.com'), 1, 24) AS profile_id,
          CASE WHEN c_custkey % 3 = 0 THEN 'newer ' ELSE 'first ' END || c_name AS title, how
        FROM customer, (VALUES ('ids'), ('id'), ('email')) t(how)
        WHERE CASE how WHEN 'ids' THEN c_custkey % 7 = 0 WHEN 'id' THEN c_custkey = 42 ELSE c_custkey = 43 END""",
)
def store_lookup(spark, sf_dir):
    """Profiles of a store of two batches by a table of ids, by one id and by an e-mail; only the buckets of these are opened."""
    _, store = _sinks(spark, sf_dir, "lookup")
    key = F.col("c_custkey")
    email = F.concat(F.lit("c"), key, F.lit("@example.com"))
    for number, (label, those) in enumerate((("first ", F.lit(True)), ("newer ", key % 3 == 0))):
        title = F.concat(F.lit(label), F.col("c_name"))
        fields = [(title if f.name == "title" else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.PARSED_DATA]
        rows = table(spark, sf_dir, "customer").where(those)
        store.upsert(rows.select(email.alias("email"), F.lit(number).cast("bigint").alias("seq"), F.struct(*fields).alias("parsed_data"), F.lit(None).cast("map<string,string>").alias("other_contacts")))
    ids = table(spark, sf_dir, "customer").where(key % 7 == 0).select(profile_key(email).alias("profile_id"))
    one = hashlib.sha256(b"c42@example.com").hexdigest()[:24]
    found = {"ids": store.by_ids(ids), "id": store.by_id(one), "email": store.by_email("c43@example.com")}
    parts = [df.select("email", "profile_id", "parsed_data.title", F.lit(how).alias("how")) for how, df in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- ingestion -------------------------------------------------------------------------------------


def _sinks(spark, sf_dir, kind):
    folder = work_folder(spark, sf_dir, f"{kind}-{next(_runs)}")
    return folder, ProfileStore(spark, f"{folder}/profiles", buckets=4).create()


def _stored(store):
    return store.read().select(
        "profile_id", "email", "seq", F.col("parsed_data.title").alias("title"), F.col("parsed_data.resume_type").alias("resume_type")
    )


_STORED_SQL = f"""WITH {EXPECTED}, good AS (SELECT * FROM outcome WHERE error_class IS NULL)
    SELECT substr(sha256(email), 1, 24) AS profile_id, email, max(k) AS seq, arg_max(title, k) AS title, arg_max(lower(c_mktsegment), k) AS resume_type
    FROM good GROUP BY email"""


def run_stream(spark, sf_dir, files=4, files_per_batch=2):
    """Documents written as files and ingested in several micro-batches; returns folder and store."""
    folder, store = _sinks(spark, sf_dir, "stream")
    names = [c.split()[0] for c in DOCUMENT.split(", ")]
    documents(spark, sf_dir).select(*names).repartition(files, "doc_id").write.parquet(f"{folder}/in")
    ingest(spark, f"{folder}/in", store, f"{folder}/outcome", f"{folder}/updates", f"{folder}/checkpoint", at="2024-02-02", files_per_batch=files_per_batch)
    return folder, store


@query("stream_ingest", _STORED_SQL)
def stream_ingest(spark, sf_dir):
    """The store after the stream has taken in all files."""
    return _stored(run_stream(spark, sf_dir)[1])


@query("batch_ingest", _STORED_SQL)
def batch_ingest(spark, sf_dir):
    """The store after the same documents came as one batch."""
    folder, store = _sinks(spark, sf_dir, "batch")
    apply_batch(documents(spark, sf_dir), 0, store, f"{folder}/outcome", f"{folder}/updates", "2024-02-02")
    return _stored(store)


@query(
    "ingest_tracking",
    f"""WITH {EXPECTED} SELECT k::VARCHAR AS file, CASE WHEN error_class IS NULL THEN 'completed' WHEN k % 2 = 0 THEN 'failed' ELSE 'in_progress' END AS parsing_status,
          CASE WHEN error_class IS NULL THEN 0 WHEN k % 2 = 0 THEN 3 ELSE 1 END::INTEGER AS no_of_retries,
          CASE WHEN error_class IS NULL THEN substr(sha256(email), 1, 24) ELSE '' END AS parsed_data_id,
          CASE WHEN error_class IS NULL THEN lower(c_mktsegment) ELSE '' END AS resume_category,
          CASE WHEN error_class IS NULL THEN '2024-02-02' ELSE '2024-02-01' END AS modified_on
        FROM outcome""",
)
def ingest_tracking(spark, sf_dir):
    """The stored tracking table after intake, a batch of all documents and two more tries of every other one.

    Three failed tries make a document failed; several uploads may share a profile.
    """
    folder, store = _sinks(spark, sf_dir, "tracked")
    docs = documents(spark, sf_dir)
    tracking = TrackingStore(spark, f"{folder}/tracking")
    rows = tracking.add(docs.select(F.col("doc_id").alias("file")), "2024-02-01 00:00:00")
    apply_batch(docs, 0, store, f"{folder}/outcome", f"{folder}/updates", "2024-02-02")
    first = spark.read.parquet(f"{folder}/updates")
    again = first.where("failed_tries > 0 AND id % 2 = 0")  # the same replies fail the same way
    tracking.settle(keyed_log(first.unionByName(again).unionByName(again), rows))
    return tracking.read().select(
        "file", "parsing_status", "no_of_retries", "parsed_data_id", "resume_category", F.date_format("modified_at", "yyyy-MM-dd").alias("modified_on")
    )


# --- ingestion from raw parts ------------------------------------------------------------------------

_parts_runs = {}
_START = "TIMESTAMP '2024-02-02 00:00:00'"
_DROPS = (0, 100, 200, 850, 900, 1000, 2100, 3900, 6000)  # seconds; the sixth brings late replies, those without parts move the clock


def _dropped(seconds):
    return F.expr(f"{_START} + make_interval(0, 0, 0, 0, 0, 0, {seconds})")


def run_parts(spark, sf_dir):
    """Turns, web pages and replies of the customers as files of nine drops, streamed a drop a batch.

    A part comes with one of the first three drops. Every 43rd reply never comes, every 16th of the others only after the
    first wait. Returns the folder, the profile store, the tracking table and the documents by tracking id. A session
    streams the parts of a folder once.
    """
    run = spark.sparkContext.applicationId, sf_dir
    if run not in _parts_runs:
        _parts_runs[run] = _run_parts(spark, sf_dir)
    return _parts_runs[run]


def _run_parts(spark, sf_dir):
    folder, store = _sinks(spark, sf_dir, "parts")
    tracking = TrackingStore(spark, f"{folder}/tracking")
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("file"), "seq", "reply")
    ids = tracking.add(docs.select("file"), "2024-02-01 00:00:00").select("file", "id")
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("file"), F.col("turn").cast("bigint").alias("page"), "text")
    web = table(spark, sf_dir, "pages").select(F.expr("cast(page_id div 10 AS string)").alias("file"), F.col("page_id").cast("bigint").alias("page"), "html")
    totals = turns.groupBy("file").agg(F.count_distinct("page").alias("pages")).join(web.groupBy("file").agg(F.count("*").alias("web_pages")), "file", "left").na.fill(0, ["web_pages"])
    number = F.col("file").cast("bigint")
    reply_drop = F.when(number % 43 == 7, -1).when(number % 16 == 5, 5).otherwise(number % 3)
    kinds = {
        "pages": (turns.join(totals, "file").withColumn("drop", (number + F.col("page")) % 3), PAGES),
        "web": (web.withColumn("drop", F.col("page") % 3), WEB_PAGES),
        "replies": (docs.withColumn("drop", reply_drop), REPLIES),
    }
    clock = spark.range(1).select(F.lit(None).cast("string").alias("doc_id"))
    for kind, (rows, shape) in kinds.items():
        names = [c.split()[0] for c in shape.split(", ")]
        keyed = rows.join(ids, "file").withColumnRenamed("id", "doc_id")
        for i, seconds in enumerate(_DROPS):
            own = keyed.where(F.col("drop") == i).unionByName(clock, allowMissingColumns=True).withColumn("at", _dropped(seconds))
            own.select(*names).coalesce(1).write.mode("append").parquet(f"{folder}/in/{kind}")
    ingest_parts(spark, *(f"{folder}/in/{k}" for k in kinds), store, tracking, f"{folder}/run", at="2024-02-03", files_per_batch=1)
    return folder, store, tracking, ids


_PARTS_SQL = f"""WITH {EXPECTED}, c AS (SELECT conv_id, {cleaned('text')} AS c FROM ({ASSEMBLED})),
      t AS (SELECT conv_id, {EMAIL_SQL} AS text_email, {MOBILE_SQL} AS text_mobile FROM c),
      told_pages AS (SELECT DISTINCT conv_id FROM conversations), told_web AS (SELECT DISTINCT page_id // 10 AS doc FROM pages),
      own AS (SELECT expected.*, t.conv_id IS NOT NULL AS has_text, told_pages.conv_id IS NOT NULL AS counted, told_web.doc IS NOT NULL AS has_web,
          k % 43 = 7 AS never, k % 43 <> 7 AND k % 16 = 5 AS late, coalesce(text_email, own_email) AS email,
          coalesce(text_mobile, CASE WHEN k % 4 = 1 THEN '+91 ' || (9000000000 + k) WHEN k % 4 = 2 THEN NULL ELSE own_mobile END) AS mobile
        FROM expected LEFT JOIN t ON t.conv_id = k LEFT JOIN told_pages ON told_pages.conv_id = k LEFT JOIN told_web ON told_web.doc = k),
      ended AS (SELECT *, CASE WHEN NOT has_text THEN 'extraction' WHEN never OR len(errors) > 0 THEN 'parsing'
            WHEN k % 41 = 20 OR coalesce(email, '') = '' OR mobile IS NULL THEN 'saving' ELSE 'none' END AS error_class,
          counted OR has_web OR NOT never AS seen FROM own)"""


@query(
    "parts_stream",
    f"""{_PARTS_SQL} SELECT k AS c_custkey, error_class, CASE WHEN is_object AND k % 41 <> 20 AND NOT never THEN email END AS email,
          CASE WHEN is_object AND k % 41 <> 20 AND NOT never THEN mobile END AS mobile FROM ended WHERE seen""",
)
def parts_stream(spark, sf_dir):
    """The last outcome of each document whose parts came over several batches: that of ``page_profiles`` where the reply came."""
    folder, _, _, ids = run_parts(spark, sf_dir)
    outcomes = spark.read.option("basePath", f"{folder}/run/outcome").parquet(f"{folder}/run/outcome/batch=*")
    last = outcomes.groupBy("doc_id").agg(F.max_by(F.struct("error_class", "parsed_data.personal_information"), "batch").alias("o"))
    own = F.col("o.personal_information")
    return last.join(ids, F.col("doc_id") == F.col("id")).select(F.col("file").cast("bigint").alias("c_custkey"), "o.error_class", own["email"].alias("email"), own["mobile"].alias("mobile"))


@query(
    "parts_tracking",
    f"""{_PARTS_SQL} SELECT k::VARCHAR AS file, CASE WHEN NOT seen THEN 'in_progress' WHEN error_class = 'none' THEN 'completed' ELSE 'failed' END AS parsing_status,
          CASE WHEN NOT seen THEN 0 WHEN never THEN 3 ELSE (CASE WHEN error_class = 'none' THEN 0 ELSE 1 END) + (CASE WHEN late AND (counted OR has_web) THEN 1 ELSE 0 END) END::INTEGER AS no_of_retries,
          CASE WHEN seen AND error_class = 'none' THEN substr(sha256(email), 1, 24) ELSE '' END AS parsed_data_id,
          CASE WHEN seen AND error_class = 'none' THEN lower(c_mktsegment) ELSE '' END AS resume_category,
          CASE WHEN seen AND error_class = 'none' THEN '2024-02-03' ELSE '2024-02-01' END AS modified_on
        FROM ended""",
)
def parts_tracking(spark, sf_dir):
    """The tracking table that the stream keeps: late replies cost a try, missing ones all three, the rest is closed after the last wait."""
    tracking = run_parts(spark, sf_dir)[2]
    return tracking.read().select(
        "file", "parsing_status", "no_of_retries", "parsed_data_id", "resume_category", F.date_format("modified_at", "yyyy-MM-dd").alias("modified_on")
    )


@query(
    "folder_cleanup",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 1 THEN 'completed' WHEN s_suppkey % 3 = 2 THEN 'failed' ELSE 'in_progress' END AS parsing_status,
          s_suppkey % 3 <> 1 AS still_there, s_suppkey % 3 = 1 AND s_suppkey % 2 = 0 AS archived, length(s_name)::BIGINT + 1 AS size FROM supplier""",
)
def folder_cleanup(spark, sf_dir):
    """A file a supplier: taken in from its folder in two goes, settled, and removed (odd ones) or archived (even ones) once completed."""
    folder = work_folder(spark, sf_dir, f"uploads-{next(_runs)}")
    tracking = TrackingStore(spark, f"{folder}/tracking")
    number = F.regexp_extract("file", "key=([0-9]+)", 1).cast("bigint")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), (F.col("s_suppkey") % 2).alias("half"), F.col("s_name").alias("value"))
    rows = spread(rows, "key")  # a file a key, and opening files is what takes time
    for half in (0, 1):
        rows.where(F.col("half") == half).write.partitionBy("half", "key").mode("append").text(f"{folder}/in")
        take_in(spark, f"{folder}/in", tracking, "2024-02-01 00:00:00")
    listed(spark, f"{folder}/in").write.parquet(f"{folder}/listed")
    done = F.col("key") % 3 == 1
    log = tracking.read().select("id", number.alias("key")).where("key % 3 > 0").select(
        "id",
        F.lit(1).cast("bigint").alias("seq"),
        F.when(done, K.COMPLETED).alias("parsing_status"),
        F.when(done, "x").alias("resume_category"),
        F.when(done, "y").alias("parsed_data_id"),
        F.lit("2024-02-02").cast("timestamp").alias("at"),
        F.when(done, 0).otherwise(K.MAX_RETRIES).alias("failed_tries"),
    )
    tracking.settle(log, "uploads", 0)
    clean_up(spark, f"{folder}/in/half=0", tracking, f"{folder}/archive")
    clean_up(spark, f"{folder}/in/half=1", tracking)

    def there(place):
        return listed(spark, f"{folder}/{place}").select(number.alias("s_suppkey"), F.lit(True).alias(place))

    every = tracking.read().select(number.alias("s_suppkey"), "parsing_status")
    sizes = spark.read.parquet(f"{folder}/listed").select(number.alias("s_suppkey"), "size")
    joined = every.join(sizes, "s_suppkey").join(there("in"), "s_suppkey", "left").join(there("archive"), "s_suppkey", "left")
    return joined.select("s_suppkey", "parsing_status", F.col("in").isNotNull().alias("still_there"), F.col("archive").isNotNull().alias("archived"), "size")
