"""Work that is heavy for each row takes all cores, however few files and row groups its rows lie in."""

from dossier.workload.reply_queries import normalise_nested
from dossier.workload.replies import documents


def test_documents_of_one_small_file_are_many_partitions(spark, tmp_path):
    rows = [(k, f"Customer#{k}", k % 25, float(k), "BUILDING") for k in range(3000)]
    shape = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    spark.createDataFrame(rows, shape).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    assert spark.read.parquet(str(tmp_path / "customer.parquet")).rdd.getNumPartitions() == 1
    for df in (documents(spark, str(tmp_path)).select("doc_id"), normalise_nested(spark, str(tmp_path)).select("c_custkey")):
        sizes = df.groupBy(spark_partition().alias("p")).count().collect()
        assert len(sizes) >= 4 * spark.sparkContext.defaultParallelism
        assert max(r["count"] for r in sizes) < 2 * min(r["count"] for r in sizes)


def spark_partition():
    from pyspark.sql import functions as F

    return F.spark_partition_id()
