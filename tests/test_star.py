"""The skills of the star profiles: ranks without a window, and without dealing the rows anew for it."""

from pathlib import Path

from pyspark.sql import functions as F

from dossier.operators.hotkeys import tasks_for
from dossier.sources.files import read_csv, write_csv
from dossier.workload import export_queries, star
from dossier.workload.star import star_jobs, star_skills, star_store


def test_skills_by_quantity_in_few_shuffles(spark, tmp_path):
    def write(name, rows, shape):
        spark.createDataFrame(rows, shape).write.parquet(str(tmp_path / f"{name}.parquet"))

    write("orders", [(1, 7), (2, 7), (3, 8)], "o_orderkey bigint, o_custkey bigint")
    write("part", [(k, f"name {k}", f"brand {k % 5}", None if k == 4 else "type") for k in range(6)], "p_partkey bigint, p_name string, p_brand string, p_type string")
    write("lineitem", [(1, 0, 3.0), (1, 1, 9.0), (2, 5, 5.0), (2, 2, 9.0), (2, 3, None), (2, 4, 1.0), (3, 1, float("nan")), (3, 0, 50.0)], "l_orderkey bigint, l_partkey bigint, l_quantity double")
    df = star_skills(spark, str(tmp_path))
    got = {r.o_custkey: r for r in df.collect()}
    assert got[7].languages_p == ["brand 1", "brand 2", "brand 0"] and got[7].languages_a == ["brand 4", "brand 3"]
    assert got[7].technologies_p == ["name 1", "name 2", "name 5"] and got[7].technologies_a == ["name 0", "name 4", "name 3"]
    assert got[7].frameworks_p == ["type", None] and got[7].frameworks_a == []
    assert [(b["rank"], b.skill, b.qty) for b in got[7].brands] == [(1, "brand 1", 9.0), (2, "brand 2", 9.0), (3, "brand 0", 8.0), (4, "brand 4", 1.0), (5, "brand 3", None)]
    assert got[8].languages_p == ["brand 1", "brand 0"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("Initial Plan")[-1]
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") <= 4


def test_tasks_follow_the_rows_and_a_hot_customer_is_spread(spark, tmp_path, monkeypatch):
    orders = [(k, 1 if k % 3 else k, "FOP"[k % 3], float(k), f"{1995 + k % 4}-03-0{1 + k % 9} 00:00:00", f"{1 + k % 5}-X") for k in range(900)]
    orders += [(900 + k, None, "F", 1.0, "1995-01-01 00:00:00", "1-X") for k in range(300)]
    made = spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string")
    made.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(1200).selectExpr("id AS l_orderkey", "id % 6 AS l_partkey", "cast(id % 50 AS double) AS l_quantity").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(6).selectExpr("id AS p_partkey", "'n' || id % 4 AS p_name", "'b' || id % 3 AS p_brand", "'t' AS p_type").write.parquet(str(tmp_path / "part.parquet"))
    assert tasks_for(made, 100) == 12 and tasks_for(made, 10_000) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(star, "tasks_for", lambda df: 37)
    skills, jobs = star_skills(spark, str(tmp_path)), star_jobs(spark, str(tmp_path))
    assert skills.rdd.getNumPartitions() == jobs.rdd.getNumPartitions() == 37
    want = {}
    for k, customer, *_ in orders:
        brands = want.setdefault(customer, {})
        brands[f"b{k % 6 % 3}"] = brands.get(f"b{k % 6 % 3}", 0) + k % 50
    assert {r.o_custkey: {b.skill: b.qty for b in r.brands} for r in skills.collect()} == want
    got = {r.o_custkey: r for r in jobs.collect()}
    assert {k: r.n for k, r in got.items()} == {c: sum(o[1] == c for o in orders) for c in want}
    groups = {(int(o[4][:4]), o[2], o[5]) for o in orders if o[1] == 1}
    assert len(got[1].experience) == len(groups) and got[1].ft == sum(o[3] for o in orders if o[1] == 1) / 100000


def test_csv_files_are_of_bounded_rows(spark, tmp_path):
    write_csv(spark.range(0, 25, 1, 1).selectExpr("cast(id AS string) AS a", "'x\ny' AS b"), str(tmp_path / "csv"), rows=10)
    back = read_csv(spark, str(tmp_path / "csv"))
    assert len(list((tmp_path / "csv").glob("part-*"))) == 3
    assert sorted(int(r.a) for r in back.collect()) == list(range(25)) and {r.b for r in back.collect()} == {"x\ny"}


def test_csv_export_writes_all_rows_compressed(spark, make_profiles, monkeypatch):
    rows = {f"{k:03}": {"title": f'a "title"\nof two lines, {k}', "overall_summary_of_candidate": "long" * 200} for k in range(60)}
    monkeypatch.setattr(export_queries, "star_store", lambda spark, sf_dir: make_profiles(rows))
    flat = export_queries.csv_export(spark, "own rows")
    got = {r.Title: r.Overall_Summary for r in flat.collect()}
    assert flat.count() == 60 and got == {r["title"]: r["overall_summary_of_candidate"] for r in rows.values()}
    files = [Path(f.removeprefix("file:")) for f in flat.inputFiles()]
    assert files and all(f.name.endswith(".csv.gz") for f in files)
    assert sum(f.stat().st_size for f in files) < sum(map(len, got.values())) / 4


def _shuffle_files(spark):
    spark._jvm.System.gc()
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "shuffle_" in f}


def _tables(spark, path):
    orders = [(k, k % 40, "FOP"[k % 3], 1000.0 * k, f"{1995 + k % 4}-03-0{1 + k % 9} 00:00:00", f"{1 + k % 5}-X" if k % 6 else None) for k in range(600)]
    made = spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string")
    tables = {
        "orders": made.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")),
        "lineitem": spark.range(1200).selectExpr("id % 600 AS l_orderkey", "id % 7 AS l_partkey", "cast(id % 50 AS double) AS l_quantity"),
        "part": spark.range(7).selectExpr("id AS p_partkey", "'n' || id AS p_name", "'b' || id % 3 AS p_brand", "'t' || id % 2 AS p_type"),
        "customer": spark.range(50).selectExpr("id AS c_custkey", "'C' || id AS c_name", "cast(id % 2 AS int) AS c_nationkey", "1.0 * id AS c_acctbal", "'S' AS c_mktsegment"),
        "nation": spark.range(2).selectExpr("cast(id AS int) AS n_nationkey", "'N' || id AS n_name", "0 AS n_regionkey"),
        "region": spark.range(1).selectExpr("cast(id AS int) AS r_regionkey", "'R' AS r_name"),
    }
    for name, df in tables.items():
        df.write.parquet(str(path / f"{name}.parquet"))
    return orders


def test_store_deals_narrow_rows_and_leaves_no_shuffle_files(spark, tmp_path, monkeypatch):
    orders = _tables(spark, tmp_path)
    plans = []
    write = star.write_dealt
    monkeypatch.setattr(star, "write_dealt", lambda df, path: (plans.append(df._jdf.queryExecution().optimizedPlan()), write(df, path)))
    before = _shuffle_files(spark)
    people = star_store(spark, str(tmp_path))
    assert not _shuffle_files(spark) - before
    node = plans[-1]
    while node.nodeName() != "RebalancePartitions":
        node = node.child()
    assert "groups#" in node.output().mkString(",") and "parsed_data#" not in node.output().mkString(",")
    got = {r.seq: r.parsed_data for r in people.collect()}
    assert sorted(got) == list(range(50)) and got[45].experience is None
    mine = [o for o in orders if o[1] == 8]
    groups = sorted({(int(o[4][:4]), o[2], o[5] or "") for o in mine})
    jobs = got[8].experience
    assert [j.company_information.name for j in jobs] == [f"co-{status.lower()}-{year}" for year, status, _ in groups]
    sizes = {"1": "<50", "2": "50-200", "3": "200-500", "4": "500-1000", "5": ">1000", "": ">1000"}
    assert [j.company_information.company_size_range for j in jobs] == [sizes[priority[:1]] for *_, priority in groups]
    assert sum(j.company_information.total_duration_in_years for j in jobs) * 100000 == sum(o[3] for o in mine)
    assert len(got[8].projects_outside_of_work) == sum(max(o[3] for o in mine if (int(o[4][:4]), o[2], o[5] or "") == g) > 450000 for g in groups) > 0
    assert sorted(got[8].skills.languages.proficient) == ["b0", "b1", "b2"] and len(got[8].skills.skill_entries) == 3
