"""Store, ingestion and export on written tables."""

import csv
import glob
import json

import pytest
from pyspark.sql import functions as F

from dossier import schema
from dossier.operators.contacts import contact_gate, merge_contacts
from dossier.operators.export import csv_columns, decorate
from dossier.plans.retrieval import answer, retrieve_csv, retrieve_json, retrieve_page
from dossier.sources.files import read_csv, read_documents, write_csv, write_json
from dossier.sources.store import ProfileStore
from dossier.sources.tracking_store import TrackingStore, keyed_log
from dossier.streaming.ingest import apply_batch, ingest
from dossier.workload.replies import documents
from dossier.workload.reply_queries import run_stream
from dossier.workload.star import star_store


def batch(spark, rows):
    """(email, seq, title) as a batch of profiles."""
    df = spark.createDataFrame(rows, "email string, seq long, title string")
    fields = [F.col("title") if f.name == "title" else F.lit(None) for f in schema.PARSED_DATA]
    return df.select("email", "seq", F.struct(*fields).cast(schema.PARSED_DATA).alias("parsed_data"), F.lit(None).cast("map<string,string>").alias("other_contacts"))


def content(store):
    return {r.email: (r.profile_id, r.seq, r.title) for r in store.read().select("email", "profile_id", "seq", "parsed_data.title").collect()}


def test_upsert(spark, tmp_path):
    store = ProfileStore(spark, str(tmp_path / "s"), buckets=3).create()
    assert content(store) == {}
    first = batch(spark, [("a", 1, "a1"), ("a", 2, "a2"), ("b", 1, "b1"), (None, 1, "x"), ("c", 7, "c7")])
    store.upsert(first)
    once = content(store)
    assert {k: v[1:] for k, v in once.items()} == {"a": (2, "a2"), "b": (1, "b1"), "c": (7, "c7")}
    store.upsert(first)
    assert content(store) == once
    store.upsert(batch(spark, [("a", 3, "a3"), ("c", 6, "old")]))
    after = content(store)
    assert {k: v[1:] for k, v in after.items()} == {"a": (3, "a3"), "b": (1, "b1"), "c": (7, "c7")}
    assert {k: v[0] for k, v in after.items()} == {k: v[0] for k, v in once.items()}
    store.upsert(batch(spark, []).limit(0))
    assert content(store) == after and len(store.segments()) == 4
    store.compact()
    assert content(store) == after and len(store.segments()) == 1 and len(store.unreferenced()) == 4


def test_a_batch_of_one_writes_one_bucket(spark, tmp_path):
    store = ProfileStore(spark, str(tmp_path / "s"), buckets=16).create()
    store.upsert(batch(spark, [(f"e{i}", 1, "x" * 50) for i in range(400)]))
    before = set(glob.glob(str(tmp_path / "s/data/*/bucket=*/*.parquet")))
    store.upsert(batch(spark, [("e7", 2, "new")]))
    new = set(glob.glob(str(tmp_path / "s/data/*/bucket=*/*.parquet"))) - before
    assert len(new) == 1 and content(store)["e7"][1:] == (2, "new") and len(content(store)) == 400


def spoil(path, buckets):
    """Makes all files unreadable but those of some buckets, so that opening one fails."""
    for name in glob.glob(f"{path}/data/*/bucket=*/*.parquet"):
        if int(name.split("bucket=")[1].split("/")[0]) not in buckets:
            with open(name, "wb") as f:
                f.write(b"no parquet")


def test_lookups_open_the_buckets_of_the_ids(spark, tmp_path):
    store = ProfileStore(spark, str(tmp_path / "s"), buckets=16).create()
    store.upsert(batch(spark, [(f"e{i}", 1, f"t{i}") for i in range(400)]))
    store.upsert(batch(spark, [(f"e{i}", 2, f"new{i}") for i in range(0, 400, 3)]))
    rows = {r.email: (r.profile_id, r.bucket) for r in store.read().select("email", "profile_id", "bucket").collect()}
    assert len({b for _, b in rows.values()}) == 16

    def told(found):
        return sorted((r.email, r.title) for r in found.select("email", "parsed_data.title").collect())

    asked = ["e1", "e2", "e3"]
    ids = spark.createDataFrame([(rows[e][0],) for e in asked * 2] + [(None,), ("not an id",), ("f" * 23 + "0",)], "profile_id string")
    spoil(store.path, {rows[e][1] for e in asked} | {0, int("f" * 7 + "0", 16) % 16})
    assert told(store.by_ids(ids)) == [("e1", "t1"), ("e2", "t2"), ("e3", "new3")]
    assert store.by_ids(ids.limit(0)).count() == 0 and store.by_id("0" * 24).count() == 0
    spoil(store.path, {rows["e3"][1]})
    assert told(store.by_id(rows["e3"][0])) == told(store.by_email("e3")) == [("e3", "new3")]
    with pytest.raises(Exception, match="no parquet|not a Parquet|FAILED_READ_FILE|CANNOT_READ"):
        store.read().collect()


def test_a_driver_lost_before_publishing_loses_nothing(spark, tmp_path, monkeypatch):
    store = ProfileStore(spark, str(tmp_path / "s"), buckets=3).create()
    store.upsert(batch(spark, [("a", 1, "a1"), ("b", 1, "b1")]), batch_id=0)
    once = content(store)
    again = batch(spark, [("a", 2, "a2"), ("c", 1, "c1")])
    with monkeypatch.context() as m:
        m.setattr(ProfileStore, "_publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            store.upsert(again, batch_id=1)
    assert content(store) == once
    for _ in range(2):  # the replay, and one more of a batch that is published
        store.upsert(again, batch_id=1)
        assert {k: v[1:] for k, v in content(store).items()} == {"a": (2, "a2"), "b": (1, "b1"), "c": (1, "c1")}
    assert len(store.segments()) == 2
    with pytest.raises(RuntimeError):
        store._publish(2, {"segments": [], "batches": []})


def test_tracking_store(spark, tmp_path):
    store = TrackingStore(spark, str(tmp_path / "t"))
    assert store.read().count() == 0
    files = spark.createDataFrame([("f1",), ("f2",), ("f3",)], "file string")
    rows = store.add(files, "2024-01-01 00:00:00")
    store.add(files, "2024-01-01 00:00:00")
    log = [("f1", 1, "completed", "x", "p1", 0), *[("f2", i, None, None, None, 1) for i in range(3)], ("f3", 1, None, None, None, 1), ("zz", 1, None, None, None, 1)]
    shape = "id string, seq long, parsing_status string, resume_category string, parsed_data_id string, failed_tries int"
    store.settle(keyed_log(spark.createDataFrame(log, shape).withColumn("at", F.lit("2024-01-02").cast("timestamp")), rows))
    got = {r.file: (r.parsing_status, r.no_of_retries, r.parsed_data_id) for r in store.read().collect()}
    assert got == {"f1": ("completed", 0, "p1"), "f2": ("failed", 3, ""), "f3": ("in_progress", 1, "")}


LOG = "id string, seq long, parsing_status string, resume_category string, parsed_data_id string, failed_tries int, closed boolean"


def tracked(spark, rows):
    return spark.createDataFrame(rows, LOG).withColumn("at", F.lit("2024-01-02").cast("timestamp"))


def test_tracking_is_folded_alike_in_any_cut(spark, tmp_path):
    entries = [("a", 1, "completed", "x", "p1", 0, False), ("a", 3, "completed", "y", "p3", 0, False), ("a", 2, "completed", "z", "p2", 0, False)]
    entries += [("b", None, None, None, None, 1, False)] * 3 + [("b", 9, "completed", "x", "p9", 0, False), ("c", 1, None, None, None, 1, False)]
    entries += [("c", None, None, None, None, 0, True), ("d", None, None, None, None, 1, None), *[("e", None, None, None, None, 1, False)] * 3]
    wanted = None
    for run, cuts in enumerate([[entries], [entries[i : i + 2] for i in range(0, len(entries), 2)], [[e] for e in entries[::-1]]]):
        store = TrackingStore(spark, str(tmp_path / f"t{run}"))
        files = spark.createDataFrame([(x,) for x in "abcde"], "file string")
        rows = store.add(files, "2024-01-01 00:00:00")
        for number, cut in enumerate(cuts):
            store.settle(keyed_log(tracked(spark, cut), rows), "test", number)
            if run and number == 2:
                store.compact()
        got = {r.file: (r.parsing_status, r.no_of_retries, r.parsed_data_id, r.resume_category, str(r.modified_at)) for r in store.read().collect()}
        wanted = wanted or got
        assert got == wanted
    assert {k: v[:3] for k, v in wanted.items()} == {
        "a": ("completed", 0, "p3"), "b": ("completed", 3, "p9"), "c": ("failed", 1, ""), "d": ("in_progress", 1, ""), "e": ("failed", 3, ""),
    }


def test_a_log_is_applied_once_and_written_in_proportion(spark, tmp_path, monkeypatch):
    store = TrackingStore(spark, str(tmp_path / "t"))
    rows = store.add(spark.createDataFrame([(f"f{i}",) for i in range(300)], "file string"), "2024-01-01 00:00:00")
    log = keyed_log(tracked(spark, [("f7", None, None, None, None, 1, False)]), rows)
    with monkeypatch.context() as m:
        m.setattr(TrackingStore, "_publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            store.settle(log, "stream", 0)
    assert store.read().agg(F.sum("no_of_retries")).first()[0] == 0 and len(store.unreferenced()) == 1
    for _ in range(3):
        store.settle(log, "stream", 0)
        assert store.read().agg(F.sum("no_of_retries")).first()[0] == 1
    store.settle(log, "other", 0)
    store.settle(log)
    assert {r.file: r.no_of_retries for r in store.read().where("no_of_retries > 0").collect()} == {"f7": 3}
    state = store.manifest.read()[1]
    assert [spark.read.parquet(f"{store.path}/data/{n}").count() for n in state["logs"]] == [1, 1, 1]
    assert state["applied"] == {"stream": 0, "other": 0}
    with pytest.raises(RuntimeError):
        store._publish(store.manifest.version(), state)


def test_stream_equals_batch_and_replay_changes_nothing(spark, sf, tmp_path):
    docs = documents(spark, sf)
    folder, streamed = run_stream(spark, sf)
    store = ProfileStore(spark, str(tmp_path / "s"), buckets=4).create()
    for _ in range(2):
        apply_batch(docs, 0, store, str(tmp_path / "o"), str(tmp_path / "u"), "2024-02-02")
        assert content(store) == content(streamed)
    outcomes = spark.read.parquet(str(tmp_path / "o"))
    assert outcomes.count() == docs.count() == spark.read.parquet(f"{folder}/outcome").count()


def test_stream_goes_on_with_new_files_and_cleans_up(spark, sf, tmp_path):
    docs = documents(spark, sf).drop("body")
    store = ProfileStore(spark, str(tmp_path / "s"), buckets=2).create()
    sinks = [str(tmp_path / n) for n in ("o", "u", "c")]
    docs.where("seq % 2 = 0").coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    source = str(tmp_path / "in" / "*")
    ingest(spark, source, store, *sinks, at="2024-02-02", clean_source="delete")
    half = content(store)
    docs.where("seq % 2 = 1").coalesce(1).write.parquet(str(tmp_path / "in" / "b"))
    ingest(spark, source, store, *sinks, at="2024-02-02", clean_source="delete")
    whole = ProfileStore(spark, str(tmp_path / "w"), buckets=2).create()
    apply_batch(docs, 0, whole, str(tmp_path / "wo"), str(tmp_path / "wu"), "2024-02-02")
    assert 0 < len(half) < len(content(store)) and content(store) == content(whole)


def test_gate(make_profiles):
    people = make_profiles(
        {
            "none": {},
            "mail": {"personal_information": {"email": "", "mobile": "9876543210"}},
            "phone": {"personal_information": {"email": "a@b.c", "mobile": "5876543210"}},
            "fine": {"personal_information": {"email": "badly shaped", "mobile": "+91-9876543210"}},
        }
    )
    absent = {c: F.lit(None).cast("string") for c in ("linkedin_url", "github_url", "mailto", "text_email", "text_mobile")}
    got = contact_gate(merge_contacts(people.withColumns(absent)))
    assert {r.profile_id: r.gate_error for r in got.collect()} == {
        "none": "contacts_missing", "mail": "email_missing", "phone": "mobile_missing", "fine": None,
    }


@pytest.fixture(scope="module")
def people(make_profiles):
    return make_profiles(
        {
            "bare": {},
            "odd": {
                "title": 'quote " and, comma\nline',
                "skills": {
                    "languages": {"proficient": ["a", "b", "c"], "average": ["d", "e", "f"]},
                    "total_skill_experience": {"z": 1.99, "a": None},
                    "skill_entries": [{"skill": "z", "years": 1.99}, {"skill": "a", "years": None}],
                    "llm_experience": True,
                },
                "experience": [{"company_information": {"name": "x"}, "positions_held_within_the_company": []}],
                "additional_experience_summary": {"total_startup_experience": 2.5},
            },
        }
    )


def test_csv_columns(people):
    flat = csv_columns(decorate(people))
    assert len(flat.columns) == 179 == len(set(flat.columns))
    assert flat.columns[:9] == ["Name", "Email", "Mobile", "Github", "LinkedIn", "City", "Country", "Title", "Language1"]
    assert flat.columns[-2:] == ["Overall_Summary", "Parsed Data"]
    bare, odd = flat.collect()
    assert set(bare[:-1]) == {"", "false"} and odd["Language5"] == "e" and odd["LLM Experience"] == "true"
    assert (odd["Skill_Experience_1"], odd["Skill_Experience_Years_1"], odd["Skill_Experience_Years_2"]) == ("z", "1 year 12 months", "0 months")
    assert (odd["Company_Name1"], odd["Position_Held1"], odd["Total_Startup_Experience"], odd["Product_Company_Experience"]) == ("x", "", "2 years 6 months", "0 months")
    assert list(json.loads(odd["Parsed Data"])["skills"]["total_skill_experience"]) == ["z", "a"]


def test_csv_file(spark, people, tmp_path):
    flat = csv_columns(decorate(people))
    write_csv(flat.coalesce(1), str(tmp_path / "csv"))
    with open(glob.glob(str(tmp_path / "csv" / "*.csv"))[0], newline="") as f:
        rows = list(csv.reader(f))
    assert rows[0] == flat.columns and sorted(rows[1:]) == sorted(list(r) for r in flat.collect())
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "csv")).collect())) == sorted(map(tuple, flat.collect()))


def test_json_file(spark, people, tmp_path):
    write_json(decorate(people), str(tmp_path / "json"))
    docs = {d["_id"]: d["parsed_data"] for d in (json.loads(r.value) for r in spark.read.text(str(tmp_path / "json")).collect())}
    assert set(docs) == {"bare", "odd"} and docs["bare"]["title"] is None
    assert docs["odd"]["skills"]["total_skill_experience"] == {"z": "1 year 12 months", "a": "0 months"}
    assert "skill_entries" not in docs["odd"]["skills"]


def test_retrieval_outputs(spark, sf):
    store = star_store(spark, sf)
    params = {"skills_and": "LARGE"}
    shown = retrieve_page(store, params, number=1, limit=5).collect()
    assert len(shown) == 5 and "year" in shown[0].parsed_data.additional_experience_summary.years_of_full_time_experience_after_graduation
    assert retrieve_csv(store, params).count() == retrieve_json(store, params).count() > 5
    assert len(answer(store, params | {"format_type": "csv"}).columns) == 179 and answer(store, params, limit=3).count() == 3


def test_read_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    got = read_documents(spark, str(tmp_path)).first()
    assert got.text == "one\ntwo" and got.file.endswith("a.txt")
