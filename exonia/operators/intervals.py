"""Problem 3: overlapping and gapped intervals.

Method: starts and ends are ranked independently for each entity; with ranks i, a gap lies where the start of rank i + 1
exceeds the end of rank i, and the boundaries so found, taken in order, pair up to continuous periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exonia.operators.ranking import running_sums
from exonia.session import digits


def exon_pairs(models: DataFrame, keep: list[str], starts: str = "exonstarts", ends: str = "exonends") -> DataFrame:
    """One row (keep..., pos_start, pos_end) per exon of a gene model.

    Models with a null list or lists of unequal length give none, nor do pairs whose end isn't above the start or that
    don't fit an int. Empty lists give none. Repeated models give their exons again."""
    return (
        models.select(*keep, digits(starts).alias("_s"), digits(ends).alias("_e"))
        .where(F.size("_s") == F.size("_e"))
        .select(*keep, F.explode(F.arrays_zip("_s", "_e")).alias("_p"))
        .select(*keep, F.expr("try_cast(_p._s as int)").alias("pos_start"), F.expr("try_cast(_p._e as int)").alias("pos_end"))
        .where(F.col("pos_end") > F.col("pos_start"))
    )


def periods_and_gaps(intervals: DataFrame, entity: list[str], start: str = "pos_start", end: str = "pos_end") -> DataFrame:
    """(entity..., kind, pos_start, pos_end): each `block`, the largest union of overlapping or touching intervals, and each
    `gap` between the blocks of an entity, once.

    Intervals are end-exclusive 32-bit integers; those with a null bound or an end not above the start are left out. Null
    entity columns form entities of their own. Equal and nested intervals change nothing. No task gets a whole entity: its
    bounds are counted by value before they are shuffled, ranked in ranges of values, and paired within these; a row for
    each range pairs the bounds at its ends."""
    if {intervals.schema[c].dataType.typeName() for c in (start, end)} - {"integer", "short", "byte"}:
        raise TypeError("bounds of intervals must be 32-bit integers")
    sides = F.array(*(F.struct(F.col(c).alias("_v"), F.lit(int(c == start)).alias("_starts"), F.lit(int(c == end)).alias("_ends")) for c in (start, end)))
    bounds = intervals.where(F.col(end) > F.col(start)).select(*entity, F.inline(sides)).groupBy(*entity, "_v").agg(F.sum("_starts").alias("_starts"), F.sum("_ends").alias("_ends"))
    ranked = running_sums(bounds, entity, "_v", ["_starts", "_ends"])
    # With i starts and i ends up to a value, the start of rank i + 1 exceeds the end of rank i: a period ends there. The same
    # counts before a value: a period starts with it.
    ends = F.col("upto__starts") == F.col("upto__ends")
    begins = F.col("upto__starts") - F.col("_starts") == F.col("upto__ends") - F.col("_ends")
    bound = ranked.where(begins | ends).select(*entity, "_range", "_v", begins.alias("_begins"))
    after = Window.partitionBy(*entity, "_range").orderBy("_v")
    inner = bound.select(*entity, "_v", "_begins", F.lead("_v").over(after).alias("_next"))
    ranges = bound.groupBy(*entity, "_range").agg(F.min("_v").alias("_first"), F.max(F.struct("_v", "_begins")).alias("_last"))
    outer = ranges.select(*entity, "_last.*", F.lead("_first").over(Window.partitionBy(*entity).orderBy("_range")).alias("_next"))
    paired = inner.unionByName(outer).where(F.col("_next").isNotNull())
    return paired.select(*entity, F.when(F.col("_begins"), "block").otherwise("gap").alias("kind"), F.col("_v").alias("pos_start"), F.col("_next").alias("pos_end"))


def coding_blocks(genepred: DataFrame) -> DataFrame:
    """Blocks and gaps of each (organism, chrom, gene, strand) over all its transcripts; models with a null gene or strand
    are left out."""
    entity = ["organism", "chrom", "gene", "strand"]
    known = genepred.where(F.col("gene").isNotNull() & F.col("strand").isNotNull())
    return periods_and_gaps(exon_pairs(known, entity), entity)
