"""Continuous ingestion from raw parts: pages, web pages and replies of a document come when they come.

What a part tells is found where it is read, so the state of a document is a few short strings and its reply. A document
is handed on as soon as all its parts are there; what is missing is waited for as the retries are, three times, and each
time what is there is tried. Time is that of the parts, so the same parts give the same results whenever they are read.
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier import constants as K
from dossier.functions.links import link_targets
from dossier.functions.text import blank_to_null, both, either, first_email, first_mobile
from dossier.operators.contacts import profile_links
from dossier.operators.hotkeys import spread
from dossier.plans.etl import accepted, process, read_outcome, tracking_updates, write_outcome
from dossier.sources.manifest import Manifest

#: ``pages`` and ``web_pages`` tell how many there are of the document, as the reader of its file knows; null where it does not.
#: A row without ``doc_id`` is a sign of the clock: it only tells that it is ``at``.
PAGES = "doc_id string, page bigint, text string, pages bigint, web_pages bigint, at timestamp"
WEB_PAGES = "doc_id string, page bigint, html string, at timestamp"
REPLIES = "doc_id string, seq bigint, reply string, at timestamp"

LINKS = ("linkedin_url", "github_url", "mailto")
GATHERED = (
    "doc_id string, seq bigint, reply string, has_text boolean, text_email string, text_mobile string, "
    "linkedin_url string, github_url string, mailto string, tried boolean, closed boolean"
)


def parts_of(pages, web_pages, replies):
    """The three kinds as rows of one shape; page texts and HTML go no further than this."""
    lower = F.lower("text")
    told = {
        "page": pages.select(
            "doc_id", "at", "page", "pages", "web_pages", first_email(lower).alias("email"), first_mobile(lower).alias("mobile"), blank_to_null(F.col("text")).isNotNull().alias("has_text")
        ),
        "web": profile_links(web_pages.select("doc_id", "at", "page", link_targets(F.col("html")).alias("urls"))).drop("urls"),
        "reply": replies.select("doc_id", "at", "seq", "reply"),
    }
    shape = {"page": "bigint", "pages": "bigint", "web_pages": "bigint", "email": "string", "mobile": "string", "has_text": "boolean"}
    shape |= dict.fromkeys(LINKS, "string") | {"seq": "bigint", "reply": "string"}
    rows = [
        df.select("doc_id", "at", F.lit(kind).alias("kind"), *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in shape.items()])
        for kind, df in told.items()
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def _kept(fields):
    return "doc_id string, pages array<bigint>, webs array<bigint>, total_pages bigint, total_webs bigint, has_text boolean, " + "".join(
        f"{name} struct<page:bigint,found:string>, " for name in fields
    ) + "seq bigint, reply string, fresh boolean, tries int, due bigint, timer bigint, tried boolean, closed boolean"


#: What is held of a document. ``due`` and ``timer`` are milliseconds; ``tried`` and ``closed`` tell what the last step did.
HELD = _kept(("email", "mobile", *LINKS))


def _told(parts, late):
    """One row a document of what the parts of a batch tell; rows without ``doc_id`` and those not after ``late`` are left out.

    Of the finds of pages the first page's counts, of links the last page's, of replies the newest. Pages that share a
    number are told apart by their find alone: the one that sorts first, of links the last, counts.
    """
    kind = F.col("kind")

    def found(best, of, name):
        return best(F.when((kind == of) & F.col(name).isNotNull(), F.struct("page", F.col(name).alias("found")))).alias(f"new_{name}")

    def last(name):
        return F.max(F.when((kind == "page") & F.col(name).isNotNull(), F.struct("at", F.col(name).alias("n"))))["n"]

    return (
        parts.where(F.col("doc_id").isNotNull() & (F.unix_micros("at") > late * 1000))
        .groupBy("doc_id")
        .agg(
            F.collect_set(F.when(kind == "page", F.col("page"))).alias("new_pages"),
            F.collect_set(F.when(kind == "web", F.col("page"))).alias("new_webs"),
            last("pages").alias("new_total_pages"),
            last("web_pages").alias("new_total_webs"),
            F.bool_or("has_text").alias("new_has_text"),
            *[found(F.min, "page", name) for name in ("email", "mobile")],
            *[found(F.max, "web", name) for name in LINKS],
            F.max(F.when(kind == "reply", F.struct("seq", "reply"))).alias("new_reply"),
            F.min(F.unix_millis("at")).alias("new_at"),
        )
    )


def step(held, parts, watermark, late=0, waits=K.RETRY_SECONDS):
    """What is held (HELD) after a batch of parts, one join of both by document.

    A complete document is handed on (``tried``) in the batch that brings its last part, and again if something new comes.
    Any other is looked at when the first, second and last wait is over, that is when its timer is below the ``watermark``
    and no part of it came with the batch: it is handed on if it is known to be incomplete, or if something has come since it
    was last. After the last wait it is ``closed``, to be forgotten; a part that comes after that begins anew.
    """
    none = F.array().cast("array<bigint>")
    joined = held.drop("tried", "closed").join(_told(parts, late), "doc_id", "full")
    c, first, arrived = F.col, F.col("fresh").isNull(), F.col("new_at").isNotNull()
    newer = c("new_reply").isNotNull() & (c("seq").isNull() | (c("new_reply.seq") > c("seq")))
    now = {k: F.array_union(F.coalesce(k, none), F.coalesce(f"new_{k}", none)) for k in ("pages", "webs")}
    now |= {k: F.coalesce(f"new_{k}", k) for k in ("total_pages", "total_webs")}
    now["has_text"] = F.coalesce("has_text", F.lit(False)) | F.coalesce("new_has_text", F.lit(False))
    now |= {k: F.least(k, f"new_{k}") for k in ("email", "mobile")} | {k: F.greatest(k, f"new_{k}") for k in LINKS}
    now |= {k: F.when(newer, c(f"new_reply.{k}")).otherwise(c(k)) for k in ("seq", "reply")}
    same = [F.size(now[k]) == F.size(k) for k in ("pages", "webs")] + [now[k].eqNullSafe(c(k)) for k in now if k not in ("pages", "webs")]
    now["fresh"] = F.coalesce("fresh", F.lit(True)) | ~both(*same)
    now["due"] = F.when(arrived & (F.coalesce("tries", F.lit(0)) == 0), F.least("due", c("new_at") + 1000 * waits[0])).otherwise(c("due"))
    over = ~arrived & (c("timer") < watermark)
    now |= {"tries": F.coalesce("tries", F.lit(0)) + over.cast("int"), "arrived": arrived, "over": F.coalesce(over, F.lit(False))}
    taken = joined.select("doc_id", *[v.alias(k) for k, v in now.items()], "timer")

    totals = c("total_pages"), c("total_webs")
    lacking = c("reply").isNull() | either(*[F.coalesce(F.size(k) < n, F.lit(False)) for k, n in zip(("pages", "webs"), totals)])
    known = totals[0].isNotNull() & totals[1].isNotNull()  # somebody told how much there is
    tried = F.when(c("arrived"), ~lacking & known & c("fresh")).otherwise(c("over") & (lacking | c("fresh")))
    next_wait = F.element_at(F.array(*[F.lit(1000 * w) for w in waits]), F.least("tries", F.lit(len(waits) - 1)) + 1)
    due = F.when(c("over"), c("due") + next_wait).otherwise(c("due"))
    timer = F.when(c("arrived") | c("over"), F.greatest(due, F.lit(watermark + 1))).otherwise(c("timer"))
    new = {"fresh": c("fresh") & ~tried, "due": due, "timer": timer, "tried": tried, "closed": c("over") & (c("tries") == len(waits))}
    return taken.withColumns(new).select(*T._parse_datatype_string(HELD).names)


def handed_on(held):
    """The documents (GATHERED) that the last step tries, and those that it only closes."""
    finds = [F.col(f"{name}.found").alias(f"text_{name}") for name in ("email", "mobile")] + [F.col(f"{name}.found").alias(name) for name in LINKS]
    return held.where("tried OR closed").select("doc_id", "seq", "reply", "has_text", *finds, "tried", "closed")


def apply_gathered(rows, number, store, tracking, folder, at=None, source="parts"):
    """One batch of gathered documents into the outcome table, the profile store and the tracking table, once however often it is repeated.

    ``doc_id`` is the tracking id. What was gathered is written first, as asking the stream again would gather it again.
    """
    spark = store.spark
    rows.write.mode("overwrite").parquet(f"{folder}/gathered/batch={number}")
    rows = spark.read.schema(GATHERED).parquet(f"{folder}/gathered/batch={number}")
    if rows.isEmpty():
        return
    staged = f"{folder}/outcome/batch={number}"
    write_outcome(process(spread(rows.where("tried").drop("tried", "closed"))), staged)
    outcome = read_outcome(spark, staged)
    store.upsert(accepted(outcome), f"{source}-{number}")
    now = F.current_timestamp() if at is None else F.lit(at).cast("timestamp")
    log = tracking_updates(outcome, now).withColumn("closed", F.lit(False))
    given_up = rows.where("closed").select(F.col("doc_id").alias("id"), now.alias("at"), F.lit(0).alias("failed_tries"), F.lit(True).alias("closed"))
    tracking.settle(log.unionByName(given_up, allowMissingColumns=True), source, number)


class PartsState:
    """What is held of the documents, as a table a step under ``folder``/state; a manifest names the last one.

    A step reads the held documents, joins what a batch tells of them and writes the table of the next step; it is published
    after all else that the step leaves, so a step that was lost is done again with the same number and the same parts.
    Its watermark is the latest ``at`` of the steps before it less ``lateness``; parts not after that of the step before are
    dropped. The table before the last one is kept for readers, older ones are removed.
    """

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder
        self.manifest = Manifest(spark, f"{folder}/state")

    def last(self):
        """The number of the last step and what it published."""
        if self.manifest.version() < 0:
            return -1, {"batch": -1, "late": 0, "watermark": 0}
        return self.manifest.read()

    def _path(self, number):
        return f"{self.folder}/state/data/step-{number:012d}"

    def read(self, number):
        """The table of a step, with what it has closed."""
        return self.spark.read.schema(HELD).parquet(self._path(number)) if number >= 0 else self.spark.createDataFrame([], HELD)

    def advance(self, parts, batch, sink, lateness, waits):
        """One step; ``sink`` gets what is handed on and the number of the step."""
        number, known = self.last()
        at = F.unix_millis(F.max("at") - F.expr(f"INTERVAL '{lateness}'"))
        latest = parts.agg(at).first()[0]
        moved = step(self.read(number).where("NOT closed"), parts, known["watermark"], known["late"], waits)
        moved.write.mode("overwrite").parquet(self._path(number + 1))
        sink(handed_on(self.read(number + 1)), number + 1)
        ahead = max(known["watermark"], known["watermark"] if latest is None else latest)
        self.manifest.publish(number + 1, {"batch": batch, "late": known["watermark"], "watermark": ahead})
        if number >= 1:
            self.manifest.remove(self._path(number - 1))


def ingest_parts(spark, pages, web_pages, replies, store, tracking, folder, at=None, files_per_batch=1000, lateness="0 seconds", waits=K.RETRY_SECONDS):
    """Processes the files of three folders not yet seen, then stops; restart it to go on.

    ``folder`` holds the checkpoint, what is held (``PartsState``) and what steps leave: ``gathered`` and ``outcome``. A batch
    of files is a step, and the clock of the last one is followed by a step without parts. ``lateness`` is how far ``at`` may
    be out of order between files; what is later is dropped.
    """

    def read(path, shape):
        return spark.readStream.schema(shape).option("maxFilesPerTrigger", files_per_batch).parquet(path)

    state = PartsState(spark, folder)

    def sink(rows, number):
        apply_gathered(rows, number, store, tracking, folder, at)

    def take(batch, number):
        if number > state.last()[1]["batch"]:
            state.advance(batch, number, sink, lateness, waits)

    stream = parts_of(read(pages, PAGES), read(web_pages, WEB_PAGES), read(replies, REPLIES))
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    known = state.last()[1]
    if known["watermark"] > known["late"]:
        nothing = parts_of(*[spark.createDataFrame([], shape) for shape in (PAGES, WEB_PAGES, REPLIES)])
        state.advance(nothing, known["batch"], sink, lateness, waits)
    return query
