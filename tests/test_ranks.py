import random

from pyspark.sql import functions as F

from weftline.operators.ranks import running


def test_ranks_and_sums_equal_a_plain_count(spark):
    rng = random.Random(3)
    rows = [(None if i % 3 == 0 else rng.choice("ab"), rng.choice([None, 1, 2, 3]), i, rng.choice([None, 5, 0, 7])) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, score int, id int, w int").repartition(5)
    got = {r["id"]: r for r in running(df, [F.desc("score"), F.col("id")], group=["g"], sums=["w"], partitions=7).collect()}
    for g in (None, "a", "b"):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        total = 0
        for place, r in enumerate(own, 1):
            assert (got[r[2]]["rank"], got[r[2]]["before_w"]) == (place, total)
            total += r[3] or 0
    assert len(got) == len(rows)


def test_equal_rows_are_parted_and_numbered_once(spark):
    df = spark.range(5000).select(F.lit("x").alias("v"))
    got = running(df, [F.col("v")], partitions=8)
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, 5001))


def test_empty(spark):
    assert running(spark.createDataFrame([], "a int, w long"), [F.col("a")], sums=["w"]).collect() == []
