"""Small files of wide records are work for all cores."""

from pyspark.sql import functions as F

from queries.base import seed
from tamis.sources.spread import spread


def tasks_with_rows(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_one_small_file_is_dealt_to_all_cores(spark, tmp_path):
    spark.range(1000).selectExpr("id AS k", "if(id % 10 = 0, NULL, id % 7) AS v").coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    whole = spark.read.parquet(str(tmp_path / "t.parquet"))
    assert tasks_with_rows(whole) == 1
    dealt = seed(spark, str(tmp_path), "t", {"k": "k", "v": "v + 1"})
    assert tasks_with_rows(dealt) >= spark.sparkContext.defaultParallelism
    assert sorted(map(str, dealt.collect())) == sorted(map(str, whole.selectExpr("k", "v + 1 AS v").collect()))


def test_tables_with_splits_enough_stay_where_they_are(spark):
    many = spark.range(0, 1000, 1, 3 * spark.sparkContext.defaultParallelism)
    assert spread(many) is many
