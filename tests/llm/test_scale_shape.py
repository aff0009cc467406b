"""Plans and shapes that large inputs rely on."""

from pyspark.sql import functions as F

from fotoloom.llm import grouping, mixing, packing, survivorship as sv


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_survivors_are_aggregated_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("i"), F.col("id").alias("w"))
    text = plan(sv.best_record(df, "g", "i", {"w": F.col("w")}))
    assert "partial_max" in text and "Window" not in text and "collect_list" not in text
    votes = plan(sv.fuse(df, "g", {"w": F.col("w")}, F.lit(1.0), F.lit(0), 10.0))
    assert "partial_sum" in votes and "collect_list" not in votes


def test_no_cross_joins(spark):
    links = spark.range(50).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    for df in (grouping.low_diameter_groups(links, "a", "b"), packing.pack_items(spark.range(9).select("id", F.lit(3).alias("size")), "id", "size", 7)):
        assert "CartesianProduct" not in plan(df) and "BroadcastNestedLoopJoin" not in plan(df)


def test_a_third_of_all_rows_in_one_source(spark, monkeypatch):
    """No window of the mix holds more rows than a bucket."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 100)
    t = spark.createDataFrame([("hot", 0.9, 1), ("cold", 0.1, 1)], "source string, target_share double, max_repeats int")
    texts = spark.range(3000).select("id", F.when(F.col("id") % 10 == 0, "cold").otherwise("hot").alias("source"), F.lit(2).cast("bigint").alias("size"))
    mix = mixing.mix_sources(texts, t)
    assert mix.count() == 3000
    report = {r.source: r.actual_share for r in mixing.mix_report(mix, t).collect()}
    assert report == {"hot": 0.9, "cold": 0.1}


def test_hot_bucket_is_divided(spark, monkeypatch):
    """Hashes that share all but a few bits meet in hot buckets; the links stay a forest."""
    monkeypatch.setattr(grouping, "BUCKET_ROWS", 16)
    rows = [(i, f"{(1 << (i % 200)) | (1 << 255):064x}") for i in range(200)]
    links = grouping.near_hash_links(spark.createDataFrame(rows, "i bigint, h string"), "i", "h", 6)
    groups = {r.group_id for r in grouping.low_diameter_groups(links, "a", "b").collect()}
    assert groups == {0}
    assert links.count() < 200 * 200 / 4
