"""Ingestion from raw parts: what is handed on when, and batches that come again."""

import json

import pytest
from pyspark.sql import functions as F

from dossier.sources.store import ProfileStore
from dossier.sources.tracking_store import TrackingStore
from dossier.streaming import parts as P

BODY = {
    "personal_information": {"email": "own@mail.com", "mobile": "9876543210"}, "resume_type": "X", "title": "T", "overall_summary_of_candidate": "s",
    "education": [], "experience": [], "projects_outside_of_work": [],
}


def reply(**more):
    return json.dumps({"choices": [{"message": {"content": json.dumps(BODY | more)}}]})


class Drops:
    """Files of parts, streamed a drop at a time."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, str(folder)
        self.store = ProfileStore(spark, f"{folder}/profiles", buckets=2).create()
        self.tracking = TrackingStore(spark, f"{folder}/tracking")

    def drop(self, second, pages=(), web=(), replies=()):
        at = F.timestamp_seconds(F.lit(1_700_000_000 + second))
        for kind, rows, shape in (("pages", [*pages, (None, None, None, None, None)], P.PAGES), ("web", web, P.WEB_PAGES), ("replies", replies, P.REPLIES)):
            names = [c.split()[0] for c in shape.split(", ")]
            df = self.spark.createDataFrame([tuple(r) for r in rows], shape.rsplit(", ", 1)[0]).withColumn("at", at)
            df.select(*names).coalesce(1).write.mode("append").parquet(f"{self.folder}/in/{kind}")
        P.ingest_parts(self.spark, *(f"{self.folder}/in/{k}" for k in ("pages", "web", "replies")), self.store, self.tracking, f"{self.folder}/run", at="2024-02-03")

    def gathered(self):
        rows = self.spark.read.option("basePath", f"{self.folder}/run/gathered").schema(P.GATHERED).parquet(f"{self.folder}/run/gathered/batch=*")
        return sorted(((r.doc_id, r.seq, r.has_text, r.text_email, r.mailto, r.tried, r.closed) for r in rows.collect()), key=str)


@pytest.fixture
def drops(spark, tmp_path):
    return Drops(spark, tmp_path)


def test_parts_in_any_order_with_late_and_missing_ones(drops):
    ids = {r.file: r.id for r in drops.tracking.add(drops.spark.createDataFrame([(f,) for f in "abcd"], "file string"), "2024-01-01 00:00:00").collect()}
    a, b, c, d = (ids[x] for x in "abcd")
    page = "mail second@mail.com"
    drops.drop(0, pages=[(a, 2, page, 2, 1), (b, 1, "text", 1, 0), (d, 1, "text", 1, 0)], replies=[(a, 1, reply())])
    assert drops.gathered() == []
    # the rest of a, pages in the other order, and a reply for b that is no JSON
    drops.drop(100, pages=[(a, 1, "x first@mail.com y", 2, 1), (a, 1, "x first@mail.com y", 2, 1)], web=[(a, 1, '<a href="mailto:web@mail.com">')], replies=[(b, 1, "{}"), (c, 1, reply())])
    first = [(a, 1, True, "first@mail.com", "web@mail.com", True, False), (b, 1, True, None, None, True, False)]
    assert drops.gathered() == sorted(first, key=str)
    # the first wait is over for c (nobody said how much there is) and d (no reply); b gets a better reply
    drops.drop(900, replies=[(b, 2, reply())])
    assert {r[0]: r for r in drops.gathered() if r[0] in (c, d)} == {c: (c, 1, False, None, None, True, False), d: (d, None, True, None, None, True, False)}
    assert (b, 2, True, None, None, True, False) in drops.gathered()
    drops.drop(2500)
    drops.drop(9000)
    got = {r.file: (r.parsing_status, r.no_of_retries) for r in drops.tracking.read().collect()}
    assert got == {"a": ("completed", 0), "b": ("completed", 1), "c": ("failed", 1), "d": ("failed", 3)}
    assert sorted(r.email for r in drops.store.read().collect()) == ["own@mail.com", "web@mail.com"]
    # all are forgotten: what comes now begins anew
    before = len(drops.gathered())
    drops.drop(9100, pages=[(d, 1, "text", 1, 0)], replies=[(d, 1, reply(personal_information={"email": "d@mail.com", "mobile": "9876543210"}))])
    assert len(drops.gathered()) == before + 1
    assert {r.file: r.parsing_status for r in drops.tracking.read().collect()}["d"] == "completed"


def test_a_batch_that_comes_again_counts_once(drops, monkeypatch):
    rows = drops.tracking.add(drops.spark.createDataFrame([("a",), ("b",)], "file string"), "2024-01-01 00:00:00").collect()
    ids = {r.file: r.id for r in rows}
    columns = {"seq": 1, "has_text": True, "text_email": None, "text_mobile": None, "linkedin_url": None, "github_url": None, "mailto": None, "tried": True, "closed": False}
    batch = drops.spark.createDataFrame([{"doc_id": ids["a"], "reply": reply()} | columns, {"doc_id": ids["b"], "reply": None} | columns], P.GATHERED)
    with monkeypatch.context() as m:  # lost between the outcome and the tracking table
        m.setattr(TrackingStore, "settle", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            P.apply_gathered(batch, 0, drops.store, drops.tracking, drops.folder)
    for _ in range(2):
        P.apply_gathered(batch, 0, drops.store, drops.tracking, drops.folder)
        assert {r.file: (r.parsing_status, r.no_of_retries) for r in drops.tracking.read().collect()} == {"a": ("completed", 0), "b": ("in_progress", 1)}
        assert drops.store.read().count() == 1 and len(drops.store.segments()) == 1


def test_a_step_is_one_join_without_python(spark):
    at = F.timestamp_seconds(F.lit(1000))
    n = F.col("id")
    doc = F.concat(F.lit("d"), n).alias("doc_id")
    pages = spark.range(3000).select(doc, F.lit(2).cast("bigint").alias("page"), F.lit("b@mail.com a@mail.com").alias("text"), F.lit(1).cast("bigint").alias("pages"), (n % 2).alias("web_pages"), at.alias("at"))
    replies = spark.range(3000).where("id % 3 > 0").select(doc, n.alias("seq"), F.lit("{}").alias("reply"), at.alias("at"))
    web = spark.createDataFrame([], P.WEB_PAGES)
    first = P.step(spark.createDataFrame([], P.HELD), P.parts_of(pages, web, replies), 0).localCheckpoint()
    # pages and replies are there; every other document waits for a web page, every third for its reply
    assert first.where("tried").count() == 1000 and first.where("closed").count() == 0
    assert {r.found for r in first.select("email.found").distinct().collect()} == {"b@mail.com"}
    nothing = P.parts_of(spark.createDataFrame([], P.PAGES), web, spark.createDataFrame([], P.REPLIES))
    held = first
    for watermark, tried, closed in ((1_600_000, 0, 0), (1_600_001, 2000, 0), (2_900_000, 2000, 0), (9_000_000, 2000, 3000)):
        moved = P.step(held.where("NOT closed"), nothing, watermark)
        plan = moved._jdf.queryExecution().optimizedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan
        held = moved.localCheckpoint()
        assert (held.where("tried").count(), held.where("closed").count()) == (tried, closed), watermark
