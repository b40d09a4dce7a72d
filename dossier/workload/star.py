"""Profiles and tracking rows derived from the test tables.

Every list in a profile is built from groups that were aggregated first, and the number of groups
per customer is bounded by a domain (years x statuses x priorities, names of parts), so a customer with
a third of all orders has a profile of ordinary size and no task collects their orders.
"""

import zlib

from pyspark.sql import functions as F

from dossier import constants as K
from dossier import schema
from dossier.operators.hotkeys import SLICES, hot_keys, tasks_for
from dossier.session import shared_folder, shuffles_removed
from dossier.sources.store import dealt, promote, read_profiles, with_bucket, write_dealt

INDUSTRIES = [f"sector {letter}" for letter in "abcdefghijklmnopq"]  # invented
INSTITUTES = ["iit", "nit", "iiit", "bits", "other"]
AS_OF = "2024-01-31 00:00:00"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hex24(col):
    return F.lpad(F.lower(F.hex(col)), 24, "0")


def nth(values, index):
    # an index that is none would give none in a column that is said to have a value in every row
    return F.when(index.isNotNull(), F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1))


def _with_slots(orders):
    """Adds ``slot``: 0, but for orders of hot customers and of none, which are spread, so that no task gets all of them."""
    own = F.pmod(F.xxhash64("o_orderkey"), F.lit(SLICES)).cast("int")
    marked = orders.join(F.broadcast(hot_keys(orders, "o_custkey")), "o_custkey", "left")
    return marked.withColumn("slot", F.when(F.col("_hot") | F.col("o_custkey").isNull(), own).otherwise(F.lit(0))).drop("_hot")


def _skill_lists(spark, sf_dir, tasks=None):
    """Per customer the brands with their quantities, the types and the part names, the most first; their number is bounded by the domains of ``part``.

    Lines are dealt by customer while they are narrow and summed there, then the sums: tasks are as many as the lines ask for,
    so what one of them holds does not grow with the tables. The result is dealt by customer to ``tasks``, if given.
    """
    lineitem = table(spark, sf_dir, "lineitem")
    tasks = tasks or tasks_for(lineitem)
    orders = _with_slots(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))
    bought = lineitem.select("l_orderkey", "l_partkey", "l_quantity").repartition(tasks, "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    lines = bought.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    kinds = "stack(3, 'languages', p_brand, 'frameworks', p_type, 'technologies', p_name) AS (kind, skill)"
    dealt = lines.select("o_custkey", "slot", "p_brand", "p_type", "p_name", "l_quantity").repartition(tasks, "o_custkey", "slot")
    sums = dealt.selectExpr("o_custkey", "slot", kinds, "l_quantity").groupBy("o_custkey", "slot", "kind", "skill").agg(F.sum("l_quantity").alias("qty"))
    amounts = sums.drop("slot").repartition(tasks, "o_custkey").groupBy("o_custkey", "kind", "skill").agg(F.sum("qty").alias("qty"))
    # the largest first, NaN above all and none last; the place in the list is the rank, so no window has to deal the rows anew
    place = "struct(qty IS NULL AS none, NOT isnan(qty) AS number, -qty AS less, skill, qty)"
    kind_lists = [F.expr(f"array_sort(collect_list({place}) FILTER (WHERE kind = '{kind}'))").alias(kind) for kind in schema.SKILL_KINDS]
    brands = F.expr("transform(languages, b -> struct(b.skill AS skill, b.qty AS qty))").alias("languages")
    return amounts.groupBy("o_custkey").agg(*kind_lists).select("o_custkey", brands, F.col("frameworks.skill").alias("frameworks"), F.col("technologies.skill").alias("technologies"))


def _skills():
    """The columns of skills, made of the lists of ``_skill_lists``."""
    skills = {"languages": "languages.skill"} | {k: k for k in schema.SKILL_KINDS[1:]}
    first, rest = "filter({0}, (s, i) -> i < 3)", "filter({0}, (s, i) -> i >= 3)"
    lists = {f"{k}_{label}": F.expr(part.format(v)) for k, v in skills.items() for label, part in (("p", first), ("a", rest))}
    return lists | {"brands": F.expr("transform(languages, (b, i) -> struct(i + 1 AS rank, b.skill AS skill, b.qty AS qty))")}


def star_skills(spark, sf_dir):
    """Per customer the brands, types and part names by quantity."""
    return _skill_lists(spark, sf_dir).select("o_custkey", *[c.alias(name) for name, c in _skills().items()])


def _job_groups(spark, sf_dir, tasks=None):
    """Per customer the groups of orders that make up experience, education and projects; dealt by customer to ``tasks``, if given."""
    orders = table(spark, sf_dir, "orders")
    own = tasks_for(orders)
    priced = F.col("o_totalprice").cast("decimal(18,2)")
    keys = ["o_custkey", "yr", "status", "priority"]
    parts = (
        _with_slots(orders)
        .repartition(own, "o_custkey", "slot")
        .groupBy("o_custkey", "slot", F.year("o_orderdate").alias("yr"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
        .agg(
            F.count("*").alias("n"),
            F.sum(priced).alias("price"),
            F.max(priced).alias("top_price"),
            F.min("o_orderkey").alias("min_key"),
            F.max("o_orderkey").alias("max_key"),
            F.min("o_orderdate").alias("min_date"),
            F.max("o_orderdate").alias("max_date"),
        )
    )
    merged = {"n": F.sum, "price": F.sum, "top_price": F.max, "min_key": F.min, "max_key": F.max, "min_date": F.min, "max_date": F.max}
    # dealt and listed while the groups are narrow: what _jobs makes of them is several times as wide
    groups = parts.drop("slot").repartition(tasks or own, "o_custkey").groupBy(*keys).agg(*[f(c).alias(c) for c, f in merged.items()])

    def total(condition):
        return (F.sum(F.when(F.expr(condition), F.col("price"))).cast("double") / 100000)

    def per_status(status):
        mine = F.col("status") == status
        return F.struct(
            F.sum(F.when(mine, F.col("n"))).alias("n"), F.min(F.when(mine, F.col("yr"))).alias("first"), F.max(F.when(mine, F.col("yr"))).alias("last")
        ).alias(f"edu_{status}")

    return groups.groupBy("o_custkey").agg(
        # no two have the same year, status and priority
        F.array_sort(F.collect_list(F.struct(*keys[1:], *merged))).alias("groups"),
        total("true").alias("ft"),
        total("status = 'P'").alias("st"),
        total("status = 'P' AND yr < 1998").alias("es"),
        total("status = 'F'").alias("pr"),
        total("status = 'O'").alias("se"),
        F.sum("n").alias("n"),
        F.max_by(F.lower("priority"), F.struct("max_date", "max_key")).alias("held"),
        *[per_status(s) for s in "FOP"],
    )


def _job(g):
    position = F.lower(g["priority"])

    def month(col):
        return F.lower(F.date_format(col, "MMMM yyyy"))

    company = F.struct(
        F.concat(F.lit("co-"), F.lower(g["status"]), F.lit("-"), g["yr"]),
        position,
        F.concat(F.lit("city "), g["min_key"] % 50),
        F.when(g["min_key"] % 7 != 0, F.concat(F.lit("country "), g["min_key"] % 5)),
        month(g["min_date"]),
        month(g["max_date"]),
        g["price"].cast("double") / 100000,
        F.coalesce(nth(K.COMPANY_SIZES, F.left(g["priority"], F.lit(1)).cast("int") - 1), F.lit(K.COMPANY_SIZES[-1])),
        F.lit(None),
        F.when(g["status"] == "F", "product").when(g["status"] == "O", "service").otherwise("startup"),
        g["min_key"] % 13 == 0,
        F.when(g["max_key"] % 2 == 0, "yes").otherwise("no"),
        g["status"] == "P",
        F.when(g["max_key"] % 11 != 0, nth(INDUSTRIES, g["min_key"] % 17)),
    )
    none = F.lit(None)  # there are no undeclared keys
    held = F.struct(F.concat(position, F.lit(" engineer")), month(g["min_date"]), month(g["max_date"]), F.expr("cast(array() AS array<struct<a:string,b:string,c:map<string,string>>>)"), none)
    positions = F.when(g["priority"] == "3-MEDIUM", F.slice(F.array(held), 1, 0)).otherwise(F.array(held))
    return F.struct(company, positions, F.concat(g["n"], F.lit(" orders")))


def _project(g):
    return F.struct(F.concat(F.lit("project "), g["max_key"]), F.concat(F.lit("worth "), g["top_price"].cast("bigint")), F.lit(None))


def _jobs():
    """The columns of experience and projects, made of the groups of ``_job_groups``."""
    return {"experience": F.transform("groups", _job), "projects": F.transform(F.filter("groups", lambda g: g["top_price"] > 450000), _project)}


def star_jobs(spark, sf_dir):
    """Per customer experience, projects and what education is made of."""
    return _job_groups(spark, sf_dir).withColumns(_jobs()).drop("groups")


def _education(status, level):
    e = F.col(f"edu_{status}")
    n = e["n"]
    return F.when(
        n > 0,
        F.struct(
            F.lit(f"school {status.lower()}"),
            F.lit(f"{level} of orders"),
            F.lit(None),
            F.lit(None),
            e["first"],
            e["last"],
            e["last"] - e["first"],
            F.lit("offline"),
            F.when(n % 7 != 0, level),
            n % 2 == 0,
            n % 3 == 0,
            nth(INSTITUTES, n % 5),
        ),
    )


def _star_rows(spark, sf_dir):
    """What the profile of each customer is made of, with its id: several times narrower than the profile."""
    k = F.col("c_custkey")
    # one number of tasks, so that neither side is dealt anew for the join
    tasks = max(tasks_for(table(spark, sf_dir, name)) for name in ("lineitem", "orders"))
    return (
        table(spark, sf_dir, "customer")
        .select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .join(_skill_lists(spark, sf_dir, tasks).withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left")
        .join(_job_groups(spark, sf_dir, tasks).withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left")
        .withColumn("profile_id", hex24(k))
    )


def star_profiles(spark, sf_dir):
    """One profile per customer, some with missing parts."""
    return _profiles(_star_rows(spark, sf_dir))


def _profiles(rows, *kept):
    """Profiles made of ``_star_rows``, row by row, with the columns ``kept`` of these."""
    k = F.col("c_custkey")
    none = F.array().cast("array<string>")
    base = rows.withColumns(_skills() | _jobs())
    email = F.concat(F.lit("c"), k, F.lit("@example.com"))
    entries = F.transform(
        F.coalesce("brands", F.expr("cast(array() AS array<struct<rank:int,skill:string,qty:double>>)")),
        lambda b: F.struct(
            F.when(k % 7 == 0, b.skill).otherwise(F.lower(b.skill)).alias("skill"),
            F.when(~((b["rank"] == 1) & (k % 9 == 0)), b.qty / 12).alias("years"),
        ),
    )
    levels = [F.struct(F.coalesce(f"{kind}_p", none), F.coalesce(f"{kind}_a", none)) for kind in schema.SKILL_KINDS]
    flag = k % 2 == 0
    skills = F.struct(*levels, F.map_from_entries(entries), entries, F.col("c_acctbal") > 5000, F.when(k % 10 != 0, flag))
    education = F.array_compact(F.array(_education("F", "masters"), _education("O", "bachelors"), _education("P", "phd")))
    summary = F.struct("held", "ft", "st", "es", "pr", "se", flag, F.lit(None))
    parsed = F.struct(
        F.struct(F.lower("c_name"), email, (F.lit(9000000000) + k).cast("string"), F.lower("n_name"), F.lower("r_name"), F.lit(None), F.lit(None)),
        F.lower("c_mktsegment"),
        F.concat(F.lower("c_mktsegment"), F.lit(" specialist")),
        F.when(k % 30 != 7, skills),
        F.when(k % 20 == 1, F.slice(education, 1, 0)).when(k % 20 != 0, education),
        F.col("experience"),
        F.when(k % 25 != 4, F.col("projects")),
        F.when(k % 25 != 3, summary),
        F.struct(F.array(F.concat(F.lit("orders: "), F.coalesce("n", F.lit(0)))), none, F.lit(None)),
        F.concat(F.lit("summary of "), F.lower("c_name")),
    ).cast(schema.PARSED_DATA)
    return base.select(
        "profile_id",
        email.alias("email"),
        k.alias("seq"),
        parsed.alias("parsed_data"),
        F.lit(None).cast("map<string,string>").alias("other_contacts"),
        *kept,
    )


def star_tracking(spark, sf_dir):
    """One tracking row per event; errors have no profile id and no category."""
    failed = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.col("props").alias("file"),
        F.col("props").alias("storage_path"),
        F.when(failed, "failed").when(F.col("event_type") == "signup", "in_progress").otherwise("completed").alias("parsing_status"),
        (F.col("event_id") % 5).cast("int").alias("no_of_retries"),
        F.when(failed, "").otherwise(hex24(F.col("user_id"))).alias("parsed_data_id"),
        F.when(failed, "").otherwise(F.col("event_type")).alias("resume_category"),
        (F.col("ts") - F.expr("INTERVAL 1 HOUR")).alias("created_at"),
        F.col("ts").alias("modified_at"),
    )


_stores = {}


def work_folder(spark, sf_dir, name):
    """A folder of this application below the shared one."""
    mark = zlib.crc32(str(sf_dir).encode())
    return f"{shared_folder(spark)}/dossier-{spark.sparkContext.applicationId}/{mark:08x}/{name}"


def star_store(spark, sf_dir, buckets=8):
    """The star profiles as a stored table, written once per application and read by the filters."""
    path = work_folder(spark, sf_dir, "profiles")
    if path not in _stores:
        with shuffles_removed(spark):
            rows = dealt(with_bucket(_star_rows(spark, sf_dir), buckets))
            write_dealt(promote(_profiles(rows, "bucket")), path)
        _stores[path] = buckets
    return read_profiles(spark, path)
