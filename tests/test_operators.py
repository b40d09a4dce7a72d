"""Pages, paging, upsert, tracking, hot keys."""

import pytest
from pyspark.sql import functions as F

from dossier.operators import tracking as TR
from dossier.operators.hotkeys import hot_keys, lookup_join
from dossier.operators.pages import assemble_pages, contacts_in_pages, fill_blank_documents
from dossier.operators.paging import page, page_after, page_size
from dossier.operators.upsert import latest_by_key, merge_latest


def test_pages_in_order(spark):
    rows = [("d", 1, "  b "), ("d", 0, " a "), ("d", 2, ""), ("d", 3, None), ("d", 5, "e\t"), ("empty", 0, None)]
    got = assemble_pages(spark.createDataFrame(rows, "doc string, page int, text string"), "doc", "page")
    assert {r.doc: r.text for r in got.collect()} == {"d": "a \n  b \ne", "empty": ""}


def test_a_long_document_keeps_the_white_space_at_every_seam(spark):
    pages = spark.range(9000).select(F.lit("hot").alias("doc"), F.col("id").alias("page"), F.concat(F.lit(" p"), "id", F.lit(" ")).alias("text"))
    rows = assemble_pages(pages.repartition(7), "doc", "page").collect()
    assert [r.text for r in rows] == ["\n".join(f" p{i} " for i in range(9000)).strip()]


def test_contacts_of_pages(spark):
    rows = [("d", 1, "X@y.org 9876543210"), ("d", 0, "none"), ("d", 2, "z@y.org 8876543210"), ("d", 1, "a@y.org"), ("e", 0, "none"), ("f", 0, None)]
    pages = spark.createDataFrame(rows, "doc string, page long, text string")
    got = contacts_in_pages(pages, "doc", "page").orderBy("doc").collect()
    assert [tuple(r) for r in got] == [("d", "x@y.org", "9876543210", True), ("e", None, None, True), ("f", None, None, False)]


def test_fallback(spark):
    first = spark.createDataFrame([("a", " one "), ("b", " \n"), ("c", "")], "doc string, text string")
    second = spark.createDataFrame([("a", "no"), ("b", " two")], "doc string, text string")
    got = fill_blank_documents(first, second, "doc").collect()
    assert sorted((r.doc, r.text) for r in got) == [("a", "one"), ("b", "two"), ("c", None)]


def test_page_size():
    assert [page_size(x) for x in (None, "x", 0, -1, 7, "50", 5000)] == [100, 100, 100, 100, 7, 50, 1000]


def test_pages_make_the_whole(spark):
    df = spark.range(25_050).select(F.format_string("%06d", "id").alias("profile_id"), F.col("id").alias("v"))
    for first, size in ((1, 1000), (11, 1000)):
        got = [r.profile_id for n in range(first, first + 3) for r in page(df, n, size).collect()]
        assert got == [f"{i:06d}" for i in range((first - 1) * size, (first + 2) * size)]
    assert [r.v for r in page(df, 251).collect()] == list(range(25_000, 25_050))
    assert [r.v for r in page(df, "last").collect()] == list(range(25_000, 25_050))
    assert page(df, 300).count() == 0
    with pytest.raises(ValueError):
        page(df, 0)
    seen, last = 0, None
    while rows := page_after(df, last, 1000).collect():
        seen, last = seen + len(rows), rows[-1].profile_id
    assert seen == 25_050


def test_pages_are_found_by_ranges(spark, monkeypatch):
    """Keys that share a long beginning, some a prefix of others, in ranges far smaller than the table."""
    from dossier.operators import paging

    monkeypatch.setattr(paging, "RANGE", 7)
    keys = sorted({f"00{i:04x}" for i in range(0, 3000, 7)} | {f"00{i:04x}ab" for i in range(0, 500, 7)} | {"00", "0001"})
    df = spark.createDataFrame([(k,) for k in keys], "profile_id string")
    for number in (1, 2, 30, len(keys) // 5, len(keys) // 5 + 1):
        assert [r.profile_id for r in page(df, number, 5).collect()] == keys[(number - 1) * 5 : number * 5]
    assert [r.profile_id for r in page(df, "last", 5).collect()] == keys[(len(keys) - 1) // 5 * 5 :]
    assert page(df.where("false"), "last").count() == 0


BATCH = [("a", 1, "i1", "p1"), ("a", 3, "i3", "p3"), ("a", 2, "i2", "p2"), ("b", 1, "i4", "q"), (None, 9, "i5", "r")]


@pytest.mark.parametrize("number", [1, 7, "last"])
def test_a_page_runs_its_filter_twice(spark, monkeypatch, number):
    """Once for all keys and once for the rows of the page, however many ranges are counted."""
    from dossier.operators import paging

    monkeypatch.setattr(paging, "RANGE", 7)
    runs = spark.sparkContext.accumulator(0)

    def passes(n):
        runs.add(1)
        return n % 2 == 0

    rows = spark.range(200).select(F.format_string("%024x", "id").alias("profile_id"), "id").coalesce(1)
    found = page(rows.where(F.udf(passes, "boolean")("id")), number, 10)
    assert found.count() == 10 and runs.value <= 400


def test_latest_and_merge(spark):
    batch = spark.createDataFrame(BATCH, "email string, seq int, id string, payload string")
    latest = latest_by_key(batch, "email", "seq", ["id"], ["seq", "payload"])
    assert {tuple(r) for r in latest.collect()} == {("a", "i1", 3, "p3"), ("b", "i4", 1, "q")}
    stored = spark.createDataFrame([("a", "s1", 2, "old"), ("b", "s2", 5, "newer"), ("c", "s3", 1, "c")], "email string, id string, seq int, payload string")
    merged = merge_latest(stored, latest, "email", "seq", ["id"], ["payload"])
    want = {("a", "s1", 3, "p3"), ("b", "s2", 5, "newer"), ("c", "s3", 1, "c")}
    assert {tuple(r) for r in merged.collect()} == want
    assert {tuple(r) for r in merge_latest(merged, latest, "email", "seq", ["id"], ["payload"]).collect()} == want


def test_hot_key_join(spark):
    many = spark.range(6000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.concat(F.lit("k"), "id")).alias("email")
    )
    one = many.where("email IS NOT NULL AND id < 5000").groupBy("email").agg(F.max("id").alias("profile_id"))
    assert [r.email for r in hot_keys(many, "email").collect()] == ["hot"]
    got, want = lookup_join(many, one, "email", "id"), many.join(one, "email", "left")
    assert {tuple(r) for r in got.select("id", "email", "profile_id").collect()} == {tuple(r) for r in want.select("id", "email", "profile_id").collect()}
    assert got.count() == 6000


@pytest.fixture
def rows(spark):
    files = spark.createDataFrame([("f1",), ("f2",), ("f3",)], "file string")
    return TR.intake(files, "2024-01-01 00:00:00").withColumn("id", F.col("file"))


def test_intake(spark, rows):
    first = rows.orderBy("id").first()
    assert (first.parsing_status, first.no_of_retries, first.parsed_data_id, first.resume_category) == ("in_progress", 0, "", "")
    files = spark.createDataFrame([("f1",)], "file string")
    ids = [TR.intake(files, "2024-01-01 00:00:00").first().id for _ in range(2)]
    assert ids[0] == ids[1] and len(ids[0]) == 36
    twice = TR.intake(files.union(files), "2024-01-01 00:00:00").collect()
    assert len({r.id for r in twice}) == 2 and ids[0] in {r.id for r in twice}
    moment = F.timestamp_seconds(F.lit(1_700_000_000))
    zones = set()
    for zone in ("UTC", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        zones.add(TR.intake(files, moment).first().id)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert len(zones) == 1
    with pytest.raises(ValueError):
        TR.intake(files.where("false"), "2024-01-01")


def test_updates_overwrite_with_given_values_only(spark, rows):
    log = [("f1", 1, "completed", "x", 4), ("f1", 2, None, "y", 5), ("f2", 1, None, None, 6), ("zz", 1, "failed", None, 7)]
    log = spark.createDataFrame(log, "id string, seq int, parsing_status string, resume_category string, d int")
    log = log.withColumn("at", F.make_timestamp(F.lit(2024), F.lit(2), "d", F.lit(0), F.lit(0), F.lit(0)))
    got = {r.id: (r.parsing_status, r.resume_category, r.parsed_data_id, str(r.modified_at)[:10]) for r in TR.apply_updates(rows, log).collect()}
    assert got == {
        "f1": ("completed", "y", "", "2024-02-05"),
        "f2": ("in_progress", "", "", "2024-01-01"),
        "f3": ("in_progress", "", "", "2024-01-01"),
    }


def test_retries_and_failure(spark, rows):
    log = spark.createDataFrame([("f1",)] * 3 + [("f2",)] * 2, "id string")
    got = TR.mark_failed(TR.count_retries(rows, log))
    assert {r.id: (r.no_of_retries, r.parsing_status) for r in got.collect()} == {"f1": (3, "failed"), "f2": (2, "in_progress"), "f3": (0, "in_progress")}
    rolled = {r.parsing_status: (r.documents, r.retried, r.retries) for r in TR.status_rollup(got).collect()}
    assert rolled == {"failed": (1, 1, 3), "in_progress": (2, 1, 2)}


def test_page_is_read_between_its_keys(spark, sf):
    from dossier.workload.star import star_store

    plan = page(star_store(spark, sf), 2, 10)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(profile_id,00000000000000000000000a)" in plan
    assert "LessThanOrEqual(profile_id,000000000000000000000013)" in plan
