from pyspark.sql import functions as F

from quern.operators.references import MaskRule, orphan_references
from quern.operators.skew import eager_join_aggregate, heavy_keys, salted_semi_join


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_eager_join_equals_plain_join_with_a_hot_key(spark):
    left = spark.createDataFrame([("a", 1, i) for i in range(50)] + [("b", 2, 5), (None, 3, 7), ("b", 2, 5)], "k string, g int, x int").withColumn("n", F.lit("clash"))
    right = spark.createDataFrame([("a", i) for i in range(40)] + [("b", 9), (None, 1), ("c", 2)], "k string, y int")
    got = eager_join_aggregate(left, right, ["k"], ["g"], ["x"], ["y"], ["g"])
    want = left.join(right, "k").groupBy("g").agg(F.count(F.lit(1)), F.sum("x"), F.sum("y"))
    assert rows(got) == rows(want)


def test_eager_join_of_empty_tables(spark):
    none = spark.createDataFrame([], "k string, x int")
    assert eager_join_aggregate(none, none.withColumnRenamed("x", "y"), ["k"], ["k"], ["x"], ["y"]).count() == 0


def test_heavy_keys_counts_nulls_in_the_total(spark):
    df = spark.createDataFrame([("a", 1)] * 6 + [(None, 2)] * 3 + [("b", None)], "c string, f int")
    assert rows(heavy_keys(df, ["c", "f"], 0.3).select("key_field", "key_value", "n", "n_rows")) == [("c", "a", 6, 10), ("f", "1", 6, 10), ("f", "2", 3, 10)]
    assert heavy_keys(df.limit(0), ["c"], 0.1).count() == 0


def test_salted_semi_join_keeps_every_row_once(spark):
    df = spark.createDataFrame([("hot", i) for i in range(200)] + [("cold", 1), (None, 2)], "k string, id int")
    keys = spark.createDataFrame([("hot",), (None,)], "k string")
    got = salted_semi_join(df, keys, ["k"], ["id"])
    assert got.count() == 200 and got.columns == ["k", "id"]


def test_orphans_by_null_mask(spark):
    refs = spark.createDataFrame([(1, 10, "f"), (1, 10, "f"), (2, 99, "f"), (3, None, "f"), (4, None, "gone"), (5, None, None), (6, 99, None)], "id long, a long, b string")
    ids, names = spark.createDataFrame([(10,)], "id long"), spark.createDataFrame([("f",)], "n string")
    rules = [MaskRule(frozenset("ab"), {"a": "id"}, ids, "a"), MaskRule(frozenset("a"), {"a": "id"}, ids, "a"), MaskRule(frozenset("b"), {"b": "n"}, names, "b")]
    assert rows(orphan_references(refs, "id", ["a", "b"], rules)) == [(2, "a"), (4, "b"), (6, "a")]
    assert orphan_references(refs.limit(0), "id", ["a", "b"], rules).count() == 0
    assert orphan_references(refs, "id", ["a", "b"], [MaskRule(frozenset("ab"), {"a": "id"}, ids.limit(0), "a")]).count() == 2
