from pyspark.sql import functions as F

from notecode.operators import ranking as R
from notecode.operators import skew as K


def skewed(spark, n=600):
    """A third of the rows belongs to key 0."""
    key = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50)
    return spark.range(n).select(key.alias("k"), F.col("id").alias("v"), (F.col("id") % 7).alias("score"))


def test_salted_join_equals_plain_join(spark, rows):
    big = skewed(spark)
    small = spark.range(0, 60, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    hot = K.hot_keys(big, ["k"], 3)
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(K.skew_join(big, small, ["k"], how, hot, salts=5)) == rows(big.join(small, "k", how))


def test_hot_key_rows_are_spread(spark):
    big = skewed(spark).repartition(4)
    hot = K.hot_keys(big, ["k"], 1)
    assert [r[0] for r in hot.collect()] == [0]


def test_rank_across_ranges_equals_window(spark, rows):
    df = skewed(spark)
    order = [F.desc("score"), F.col("v")]
    assert rows(K.rank_in_groups(df, ["k"], order, max_group=10)) == rows(K.rank_in_groups(df, ["k"], order))
    assert rows(K.rank_in_groups(df.repartition(17), ["k"], order, max_group=10)) == rows(K.rank_in_groups(df, ["k"], order))


def test_number_rows(spark):
    numbered = K.number_rows(spark.range(100).repartition(9), [F.desc("id")], "n", start=5)
    assert [(r["id"], r["n"]) for r in numbered.orderBy("n").collect()] == [(99 - i, i + 5) for i in range(100)]


def test_top_k_is_pruned_before_the_shuffle(spark):
    top = K.top_in_groups(skewed(spark), ["k"], [F.col("v")], 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert top.filter("k = 0").count() == 3


def test_top_k_edge_cases(spark, rows):
    pred = spark.createDataFrame([(1, 5, 0.5), (1, 3, 0.5), (1, 9, 0.9)], "row_id long, label_id long, score double")
    assert rows(R.topk_per_row(pred, 2), "label_id", "rank") == [(3, 2), (9, 1)]
    assert R.topk_per_row(pred, 0).count() == 0
    assert R.topk_per_row(pred).count() == 3
    assert rows(R.relevance(pred), "label_id", "score") == [(3, 2.0), (5, 1.0), (9, 3.0)]


def test_ordinal_rank(spark, rows):
    z = spark.createDataFrame([(i, 0, float(-i)) for i in range(5)], "label_id long, dim int, val double")
    assert rows(R.ordinal_rank(z, 5, 2), "label_id", "bin") == [(0, 1), (1, 1), (2, 0), (3, 0), (4, 0)]
