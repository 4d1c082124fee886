"""Problem 2: percentiles of very large numeric columns.

Method: exact bisection. Each group and percentile has a value interval; a pass counts what lies below the midpoints of the
next halvings, and the interval narrows until the target rank is resolved. The rows counted are those of summaries, one a
group and period (say, a load day), which can be kept and combined at will: of n values a summary keeps those where the rank
passes a multiple of error * n, with the number of ranks each stands for. Ranks in a summary are too small by less than
error * n, so by less than error times all values in any combination of summaries; bisection adds nothing to that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exonia.operators.intervals import exon_pairs
from exonia.operators.ranking import running_counts
from exonia.session import discard, join_null_safe, stored

#: Largest error of a rank, as a share of the group's values.
ERROR = 0.005
PERCENTS = (1, 5, 25, 50, 75, 95, 99)
MEASURES = ("exon_start", "exon_end", "exon_length")
#: Halvings of each interval in one pass over the summaries.
HALVINGS = 8


def summaries(values: DataFrame, group: list[str], period: str, value: str, error: float = ERROR) -> DataFrame:
    """(group..., period, value, weight): of n values at most n / floor(error * n) + 1 rows for each group and period, near 1 / error
    + 1 for large n.

    value must be an integer column (scale decimals first); null values are left out. Null group columns and periods are
    groups of their own. Repeated values are counted before anything is shuffled. An empty table gives an empty one."""
    keys = [*group, period]
    counted = values.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(F.count("*").alias("_n"))
    step = F.greatest(F.lit(1), F.floor(F.lit(error) * F.col("total"))).cast("bigint")
    passed = lambda rank: F.floor(rank / step).cast("bigint") * step
    before = passed(F.col("upto") - F.col("_n"))
    weight = F.when(F.col("upto") == F.col("total"), F.col("total")).otherwise(passed(F.col("upto"))) - before
    ranked = running_counts(counted, keys, "value", "_n")
    return ranked.select(*keys, F.col("value").cast("bigint").alias("value"), weight.alias("weight")).where("weight > 0")


def percentiles(summary: DataFrame, group: list[str], percents: tuple[int, ...] = PERCENTS) -> DataFrame:
    """(group..., percent, value, n): for each percent the smallest value whose rank is at least that percent of n, the
    number of values. summary has the group, `value` and `weight`, of any number of periods.

    Ranks are exact in the summary. A pass reads the stored points once and sends on only counts: each group's open
    intervals are one row, which Spark sends to the points where it is small and otherwise joins, with the points of a hot
    group parted by its skew handling. Percents that still share an interval are counted once."""
    points = stored(summary.select(*group, "value", "weight"), "points")
    wanted = F.array(*(F.lit(p) for p in percents))
    state = (
        points.groupBy(*group)
        .agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("weight").alias("n"))
        .withColumns({"percent": F.explode(wanted), "below": F.lit(0).cast("bigint")})
        .withColumn("target", F.greatest(F.lit(1), F.expr("(n * percent + 99) div 100")))
        .select(*group, "percent", "n", "target", "below", "lo", "hi")
    )
    cells = 1 << HALVINGS
    width = F.expr(f"(hi - lo) div {cells} + 1")
    state = stored(state, "intervals")
    while not (live := state.where("lo < hi")).isEmpty():
        # The intervals of a group don't overlap unless they are the same.
        open_ = live.groupBy(*group).agg(F.collect_set(F.struct("lo", "hi", width.alias("width"))).alias("_open"))
        met = join_null_safe(points, open_, group).select(*group, "value", "weight", F.inline(F.filter("_open", lambda x: F.col("value").between(x["lo"], x["hi"]))))
        counted = met.groupBy(*group, "lo", "hi", F.expr("(value - lo) div width").alias("_cell")).agg(F.sum("weight").alias("_in"))
        # At most as many rows as there are cells in a window.
        upto = F.sum("_in").over(Window.partitionBy(*group, "lo", "hi").orderBy("_cell"))
        counted = counted.withColumn("_upto", upto)
        narrowed = (
            join_null_safe(live.withColumn("_width", width), counted, [*group, "lo", "hi"])
            .where("below + _upto >= target and below + _upto - _in < target")
            .select(*group, "percent", "n", "target", F.expr("below + _upto - _in").alias("below"), F.expr("lo + _cell * _width").alias("lo"), F.expr("least(hi, lo + (_cell + 1) * _width - 1)").alias("hi"))
        )
        after = stored(narrowed.unionByName(state.where("lo = hi")), "intervals")
        discard(state)
        state = after
    discard(points)
    return state.select(*group, "percent", F.col("lo").alias("value"), "n")


def exon_values(genepred: DataFrame) -> DataFrame:
    """(organism, chrom, measure, load_day, value): start, end and length of every exon of every row; which pairs are exons
    is as in the core's exon_pairs. measure is the place of a name in MEASURES, load_day a date."""
    exons = exon_pairs(genepred, ["organism", "chrom", "loaded_at"])
    values = (F.col("pos_start"), F.col("pos_end"), F.col("pos_end") - F.col("pos_start"))
    kinds = F.array(*(F.struct(F.lit(k).cast("tinyint").alias("measure"), v.alias("value")) for k, v in enumerate(values)))
    return exons.select("organism", "chrom", F.to_date("loaded_at").alias("load_day"), F.inline(kinds))


def named_measure() -> Column:
    return F.element_at(F.array(*map(F.lit, MEASURES)), F.col("measure") + 1)
