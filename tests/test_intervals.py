"""Problem 3 against a sweep over sorted intervals."""

import random

from exonia.operators import intervals
from exonia.operators.ranking import running_counts, running_sums
from tests.conftest import rows


def sweep(data):
    by = {}
    for e, s, t in data:
        if s is not None and t is not None and t > s:
            by.setdefault(e, []).append((s, t))
    out = []
    for e, own in by.items():
        blocks = []
        for s, t in sorted(own):
            if blocks and s <= blocks[-1][1]:
                blocks[-1][1] = max(blocks[-1][1], t)
            else:
                blocks.append([s, t])
        out += [(e, "block", s, t) for s, t in blocks] + [(e, "gap", a[1], b[0]) for a, b in zip(blocks, blocks[1:], strict=False)]
    return sorted(out, key=str)


def test_random_intervals(spark, monkeypatch):
    r = random.Random(1)
    data = []
    for _ in range(1500):
        s = r.choice([r.randint(0, 60), r.randint(0, 3000)])
        data.append((r.choice(["a", "b", None, "hot", "hot", "hot"]), s, s + r.randint(-2, 30)))
    data += [("n", None, 3), ("n", 3, None), ("one", 1, 2), ("touch", 1, 2), ("touch", 2, 3), ("far", -5, 70000), ("far", 70001, 2000000000)]
    df = spark.createDataFrame(data, "e string, pos_start int, pos_end int")
    for width in (8, 1 << 16, 1 << 20):
        monkeypatch.setattr(intervals, "running_sums", lambda *a, width=width: running_sums(*a, width=width))
        got = sorted(((x.e, x.kind, x.pos_start, x.pos_end) for x in intervals.periods_and_gaps(df, ["e"]).collect()), key=str)
        assert got == sweep(data)
    assert intervals.periods_and_gaps(df.limit(0), ["e"]).collect() == []


def test_running_counts(spark):
    df = spark.createDataFrame([("a", v, v % 3 + 1) for v in range(-20, 90, 7)] + [(None, 5, 2)], "k string, v int, n int")
    for width in (8, 1 << 20):
        total = 0
        for x in sorted(running_counts(df, ["k"], "v", "n", width=width).where("k = 'a'").collect(), key=lambda x: x.v):
            total += x.n
            assert x.upto == total and x.total == sum(v % 3 + 1 for v in range(-20, 90, 7))
        assert running_counts(df, ["k"], "v", "n", width=width).where("k is null").first().upto == 2


def test_a_sparse_hot_group_is_spread(spark):
    """Values over 10^15: no window gets the group, nor all its ranges, nor all their ranges."""
    from pyspark.sql import functions as F

    df = spark.range(4000).select(F.lit("hot").alias("k"), (F.col("id") * 250_000_000_000 - 10**14).alias("v"), F.lit(2).alias("n"))
    got = running_sums(df, ["k"], "v", ["n"], width=1 << 10)
    assert got.where("upto_n <> 2 * (v + 100000000000000) / 250000000000 + 2 or total_n <> 8000").count() == 0
    assert got.groupBy("_range").count().agg(F.max("count")).first()[0] == 1
    plan = got._jdf.queryExecution().toString()
    assert "Join" not in plan and plan.count("_range") > 0
    wide = running_sums(df.withColumn("v", F.expr("cast(v div 1000000000 as int)")), ["k"], "v", ["n"], width=1 << 10)
    assert wide.groupBy("_range").count().agg(F.max("count")).first()[0] <= 1 << 10


def test_models(spark):
    cols = "organism string, chrom string, gene string, strand string, exonstarts string, exonends string, kind string"
    data = [
        ("o", "c", "g", "+", "1,10", "5,20,", "x"), ("o", "c", "g", "+", "[4] 30", "11,40", "x"), ("o", "c", "g", "-", "1", "5", "x"), ("o", "c", "g", ".", '"7"', "7", "x"),
        ("o", "c", None, "+", "1", "5", "x"), ("o", "c", "g2", "+", None, "5", "x"), ("o", "c", "g2", "+", "1,2", "5", "x"), ("o", "c", "g3", "+", "", "", "x"), (None, None, "g", "+", "1", "99999999999", "x"),
        ("o", "c", "g", "+", "1,10", "5,20,", "x"),
    ]
    got = rows(intervals.coding_blocks(spark.createDataFrame(data, cols)))
    assert got == [("o", "c", "g", "+", "block", 1, 20), ("o", "c", "g", "+", "block", 30, 40), ("o", "c", "g", "+", "gap", 20, 30), ("o", "c", "g", "-", "block", 1, 5)]
