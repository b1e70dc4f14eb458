import random

from docloom.operators import intervals


def test_against_all_pairs(spark):
    rng = random.Random(1)

    def some(n, seed):
        out = []
        for i in range(n):
            at, length = rng.randrange(-500, 5000), rng.choice([0, -3, 1, 2, 15, 16, 17, 128, 129, 1000, 70_000])
            out.append((rng.choice(["a", "b", None]), at, at + length, i, seed))
        return out

    left, right = some(120, "l"), some(150, "r") + [("a", None, 5, 900, "r"), ("a", 0, 10**12, 901, "r")]
    schema = "k string, start long, end long, n int, side string"
    got = intervals.interval_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"])
    assert got.columns == ["k", "left", "right"]
    want = sorted((a[3], b[3]) for a in left for b in right if a[0] and a[0] == b[0] and None not in (b[1], b[2]) and a[1] < a[2] and b[1] < b[2] and a[1] < b[2] and b[1] < a[2])
    assert sorted((r.left.n, r.right.n) for r in got.collect()) == want
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_rows_stay_few_whatever_the_lengths(spark):
    long = spark.createDataFrame([("a", 0, 10**12), ("a", 5, 6)], "k string, start long, end long")
    placed = intervals._bins(intervals._prepared(long, ["k"], ("start", "end"), "left"), intervals._level(intervals.F.col("__to") - intervals.F.col("__at")))
    assert placed.count() <= 4
    assert intervals.interval_join(long, long, ["k"]).count() == 4
    assert intervals.interval_join(long.limit(0), long, ["k"]).count() == 0
