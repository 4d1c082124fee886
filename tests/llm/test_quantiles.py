"""Percentiles against sorting, with bounded summaries and days combined."""

import random

from exonia.llm import quantiles

SCHEMA = "g string, day string, v long"


def brute(values, percent):
    values = sorted(values)
    return values[max(1, -(-len(values) * percent // 100)) - 1]


def test_exact_where_days_are_small(spark):
    r = random.Random(1)
    data = [(r.choice(["a", "b", None]), f"d{r.randint(1, 9)}", r.choice([0, -5, 7, r.randint(-(10**9), 10**9)])) for _ in range(1500)]
    df = spark.createDataFrame(data + [("only", "d1", 3), ("none", "d1", None)], SCHEMA)
    got = {(x.g, x.percent): (x.value, x.n) for x in quantiles.percentiles(quantiles.summaries(df, ["g"], "day", "v"), ["g"]).collect()}
    for g in ("a", "b", None):
        own = [v for k, _, v in data if k == g]
        for p in quantiles.PERCENTS:
            assert got[g, p] == (brute(own, p), len(own))
    assert got["only", 50] == (3, 1) and not any(g == "none" for g, _ in got)


def test_error_is_bounded_and_summaries_are_small(spark):
    r = random.Random(2)
    data = [("hot", f"d{r.randint(1, 3)}", int(r.expovariate(1e-4)) if r.random() < 0.9 else 5) for _ in range(9000)]
    df = spark.createDataFrame(data, SCHEMA)
    s = quantiles.summaries(df, ["g"], "day", "v", error=0.01)
    assert s.groupBy("g", "day").count().where("count > 101").count() == 0
    assert s.agg({"weight": "sum"}).first()[0] == len(data)
    values = sorted(v for _, _, v in data)
    for x in quantiles.percentiles(s, ["g"]).collect():
        below, upto = sum(v < x.value for v in values), sum(v <= x.value for v in values)
        target = len(values) * x.percent / 100
        assert below - 0.01 * len(values) <= target <= upto + 0.01 * len(values) + 1


def test_thinned_days_keep_the_rank_bound(spark):
    r = random.Random(4)
    data = [(g, f"d{d}", int(r.gauss(k * 10**5, 10**6))) for k, g in enumerate(("a", "b")) for d in range(3) for _ in range(2500 + 700 * d)]
    s = quantiles.summaries(spark.createDataFrame(data, SCHEMA), ["g"], "day", "v").persist()
    sizes = {(x.g, x.day): x["count"] for x in s.groupBy("g", "day").count().collect()}
    for d in range(3):
        n = 2500 + 700 * d
        assert all(sizes[g, f"d{d}"] <= n // int(quantiles.ERROR * n) + 1 < n / 10 for g in "ab")
    got = {(x.g, x.percent): x for x in quantiles.percentiles(s, ["g"]).collect()}
    assert len(got) == 2 * len(quantiles.PERCENTS)
    for (g, percent), x in got.items():
        values = [v for k, _, v in data if k == g]
        below, upto, target = sum(v < x.value for v in values), sum(v <= x.value for v in values), len(values) * percent / 100
        assert x.n == len(values) and below - quantiles.ERROR * x.n <= target <= upto + quantiles.ERROR * x.n + 1
    s.unpersist()


def test_some_days_and_none(spark):
    df = spark.createDataFrame([("a", "d1", 1), ("a", "d2", 5), ("a", "d2", 5), ("a", None, 9)], SCHEMA)
    s = quantiles.summaries(df, ["g"], "day", "v")
    assert [x.value for x in quantiles.percentiles(s.where("day = 'd2'"), ["g"], (50,)).collect()] == [5]
    assert [x.value for x in quantiles.percentiles(s, ["g"], (100,)).collect()] == [9]
    assert quantiles.percentiles(s.limit(0), ["g"]).collect() == []
