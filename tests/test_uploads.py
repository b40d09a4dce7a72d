"""A folder of uploads: intake again and again, and removal of what is completed."""

from pyspark.sql import functions as F

from dossier.sources.tracking_store import TrackingStore
from dossier.sources.uploads import clean_up, listed, take_in


def completed(rows):
    values = {"seq": F.lit(1).cast("bigint"), "parsing_status": F.lit("completed"), "resume_category": F.lit("x"), "parsed_data_id": F.lit("p"), "at": F.lit("2024-02-02").cast("timestamp"), "failed_tries": F.lit(0)}
    return rows.select("id").withColumns(values)


def test_files_are_taken_in_once_and_removed_when_completed(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    for name in ("a.txt", "b c%20.txt", "sub/d.txt"):
        (folder / name).write_text(name)
    tracking = TrackingStore(spark, str(tmp_path / "t"))
    assert take_in(spark, str(folder), tracking, "2024-02-01").count() == 3
    assert take_in(spark, str(folder), tracking, "2024-02-02").count() == 0
    (folder / "e.txt").write_text("later")
    assert [r.file.rsplit("/", 1)[1] for r in take_in(spark, str(folder), tracking, "2024-02-02").collect()] == ["e.txt"]
    assert {r.file.rsplit("/", 1)[1]: r["size"] for r in listed(spark, str(folder)).collect()}["e.txt"] == 5
    assert clean_up(spark, str(folder), tracking) == 0
    done = tracking.read().where("file NOT LIKE '%a.txt' AND file NOT LIKE '%e.txt'")
    tracking.settle(completed(done), "test", 0)
    assert clean_up(spark, str(folder), tracking, str(tmp_path / "kept")) == 2
    assert sorted(p.name for p in folder.rglob("*.txt")) == ["a.txt", "e.txt"]
    assert sorted(str(p.relative_to(tmp_path / "kept")) for p in (tmp_path / "kept").rglob("*.txt")) == ["b c%20.txt", "sub/d.txt"]
    tracking.settle(completed(tracking.read().where("file LIKE '%a.txt'")), "test", 1)
    assert clean_up(spark, str(folder), tracking) == 1 and clean_up(spark, str(folder), tracking) == 0
    assert [p.name for p in folder.rglob("*.txt")] == ["e.txt"]
    assert {r.parsing_status for r in tracking.read().collect()} == {"completed", "in_progress"}


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    for i in range(200):
        (tmp_path / "in" / f"key={i}").mkdir(parents=True)
        (tmp_path / "in" / f"key={i}" / "a.txt").write_text("x")
    before = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    spark.sparkContext.setJobGroup("listing", "listing")
    files = listed(spark, str(tmp_path / "in"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    told = spark.sparkContext.statusTracker()
    stages = [s for j in told.getJobIdsForGroup("listing") for s in told.getJobInfo(j).stageIds]
    assert sum(told.getStageInfo(s).numTasks for s in stages) <= 4 * spark.sparkContext.defaultParallelism
    assert files.count() == 200
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == before
