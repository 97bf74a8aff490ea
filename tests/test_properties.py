"""Properties of the jobs: one result row per request, results independent of
the number of shuffle partitions, dedupe idempotent, score bounds."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("parts", [1, 13])
def test_partition_count_invariance(spark, parts):
    base = _rows(entry.queries()["crystal_job"](spark, SF))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        assert _rows(entry.queries()["crystal_job"](spark, SF)) == base
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_one_row_per_request(spark):
    out = entry.queries()["crystal_job"](spark, SF)
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    assert out.count() == orders.count() == out.select("row_id").distinct().count()


def test_score_bounds_and_valid_means_full_score(spark):
    c = entry.queries()["verify_score"](spark, SF)
    s = F.col("consistency_score")
    r = c.agg(F.count_if(~((s >= -46) | (s == -999))).alias("out_of_range"),
              F.count_if(F.col("valid_cif") & (s != 100)).alias("valid_not_full")).first()
    assert (r["out_of_range"], r["valid_not_full"]) == (0, 0)


def test_dedupe_idempotent(spark):
    from cribra.plans import jobs
    resp = spark.createDataFrame([(0, i, t) for i, t in enumerate(["a", " a", "b", "a  ", "c"])],
                                 "row_id long, seq int, response string")
    once = jobs.prepare_responses(resp, 10)
    twice = jobs.prepare_responses(once.withColumnRenamed("rank", "r0")
                                   .select("row_id", F.col("r0").alias("seq"), "response"), 10)
    assert [r["response"] for r in once.orderBy("rank").collect()] == \
        [r["response"] for r in twice.orderBy("rank").collect()]
