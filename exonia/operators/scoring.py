"""Log-odds scores from counts.

Scores are integers in a given scale, milli-bans by default, cut towards zero. -2147483648 stands for minus infinity (an
outcome that never occurs but would under the null model), 2147483647 for plus infinity (one that the null lacks)."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from exonia.functions.seq import NUCLEOTIDES, is_stop
from exonia.session import join_null_safe

#: Nats in one unit of each scale, and the infinities.
SCALES = {"nats": 1.0, "phred": math.log(10) / 10, "bits": math.log(2), "bans": math.log(10), "millibans": math.log(10) / 1000}
NEVER, ALWAYS = -2147483648, 2147483647
#: Site counts of the generic donor and acceptor models.
GENERIC = {"donor": {"GT": 196, "GC": 1, "AT": 1}, "acceptor": {"AG": 98, "AC": 1, "TG": 1}}


def scaled_ratio(p1: Column, p0: Column, scale: str = "millibans") -> Column:
    """int(ln(p1 / p0) / scale) for two positive probabilities."""
    return (F.ln(p1 / p0) / F.lit(SCALES[scale])).cast("int")


def log_odds(n1: Column, n0: Column, total1: Column, total0: Column, scale: str = "millibans") -> Column:
    """The score of an outcome that was counted n1 times of total1, and n0 of total0 under the null model."""
    none = F.when(n0 == 0, 0).otherwise(NEVER)
    safe = lambda c: F.when(c > 0, c).otherwise(1).cast("double")
    ratio = scaled_ratio(safe(n1) / safe(total1), safe(n0) / safe(total0), scale)
    return F.when(n1 == 0, none).when(n0 == 0, ALWAYS).otherwise(ratio).cast("int")


def score_table(counts: DataFrame, null: DataFrame, group: list[str], outcome: str, outcomes: int, null_group: list[str] | None = None, scale: str = "millibans") -> DataFrame:
    """(group..., outcome, n1, n0, score) for each outcome from 0 to outcomes - 1, counted or not.

    counts and null have (group..., outcome, n) with each outcome once; null may have fewer group columns. Groups of
    counts without null counts have n0 0. Tables of counts are small; those without rows give none."""
    shared = group if null_group is None else null_group
    # Counts are gathered, at most `outcomes` a group, instead of joined to a grid, so that they are made only once.
    entry = F.struct(F.col(outcome).cast("int").alias("k"), F.col("n").alias("v"))
    maps = counts.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.when(F.col(outcome).isNotNull(), entry))).alias("_m"))
    dense = maps.select(*group, "_m", F.explode(F.sequence(F.lit(0), F.lit(outcomes - 1))).alias(outcome))
    both = dense.select(*group, outcome, F.try_element_at("_m", F.col(outcome)).alias("n1"))
    both = join_null_safe(both, null.select(*shared, outcome, F.col("n").alias("n0")), [*shared, outcome], "left").fillna(0, ["n1", "n0"])
    per = Window.partitionBy(*group)
    return both.select(*group, outcome, "n1", "n0", log_odds(F.col("n1"), F.col("n0"), F.sum("n1").over(per), F.sum("n0").over(per), scale).alias("score"))


def divergence(table: DataFrame, group: list[str]) -> DataFrame:
    """(group..., kl): the Kullback-Leibler divergence in nats of the counts n1 from n0; null where it is infinite."""
    per = Window.partitionBy(*group)
    p, q = F.col("n1") / F.sum("n1").over(per), F.col("n0") / F.sum("n0").over(per)
    rows = table.select(*group, p.alias("_p"), q.alias("_q")).where("_p > 0")
    finite = F.min(F.col("_q") > 0)
    safe = F.when(F.col("_q") > 0, F.col("_q")).otherwise(1.0)
    return rows.groupBy(*group).agg(F.when(finite, F.sum(F.col("_p") * F.ln(F.col("_p") / safe))).alias("kl"))


def laplace_ratio(n1: Column, n0: Column, total1: Column, total0: Column, outcomes: int) -> Column:
    """The unscaled log ratio with 1 added to every count."""
    return F.ln(((n1 + 1) / (total1 + outcomes)) / ((n0 + 1) / (total0 + outcomes)))


def log_add(a: Column, b: Column) -> Column:
    """ln(exp(a) + exp(b))."""
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def generic_scores(kind: str) -> dict[str, int]:
    """The generic model's score of each dinucleotide, read in transcription direction, against a uniform null."""
    counts = GENERIC[kind]
    total = sum(counts.values())
    return {m: int(math.log(counts[m] / total * 16) / SCALES["millibans"]) if m in counts else NEVER for m in map("".join, product(NUCLEOTIDES, repeat=2))}


def generic_score(motif: Column, kind: str) -> Column:
    """The generic model's score of a dinucleotide; NEVER for anything that isn't one."""
    known = {m: s for m, s in generic_scores(kind).items() if s != NEVER}
    out = F.lit(NEVER)
    for m, s in known.items():
        out = F.when(motif == m, s).otherwise(out)
    return out


def generic_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, m, s) for k in GENERIC for m, s in generic_scores(k).items()], "site string, motif string, score int")


def site_scores(texts: DataFrame, motif_scores: DataFrame, edge_scores: DataFrame) -> DataFrame:
    """texts (organism, motif, edge, ...) with `score`: the motif's plus those of all places of the boundary; NEVER where
    one of them is, or where the site is ambiguous or doesn't fit.

    The score tables have (organism, motif_idx, score) and (organism, place, nuc_idx, score); each organism's boundary is
    put into one map, whose size the site's length bounds."""
    from exonia.functions.seq import base4

    edges = edge_scores.groupBy("organism").agg(F.map_from_entries(F.collect_list(F.struct((F.col("place") * 4 + F.col("nuc_idx")).alias("k"), F.col("score").alias("v")))).alias("_edges"))
    rows = texts.withColumn("motif_idx", base4("motif"))
    rows = join_null_safe(join_null_safe(rows, motif_scores.select("organism", "motif_idx", F.col("score").alias("_motif")), ["organism", "motif_idx"], "left"), edges, ["organism"], "left")
    letters = F.when(F.length("edge") > 0, F.split("edge", "")).otherwise(F.expr("cast(array() as array<string>)"))
    parts = F.transform(letters, lambda c, i: F.try_element_at("_edges", i * 4 + F.instr(F.lit(NUCLEOTIDES), c) - 1))
    impossible = F.col("_motif").isNull() | F.col("edge").isNull() | (F.col("_motif") == NEVER) | F.exists(letters, lambda c: ~c.isin(*NUCLEOTIDES)) | F.exists(parts, lambda s: F.coalesce(s, F.lit(NEVER)) == NEVER)
    total = F.aggregate(parts, F.col("_motif").cast("bigint"), lambda a, s: a + s)
    score = F.when(F.coalesce(impossible, F.lit(True)), NEVER).otherwise(F.least(total, F.lit(ALWAYS))).cast("int")
    return rows.withColumn("score", score).drop("motif_idx", "_motif", "_edges")


def substitution_scores(pairs: DataFrame, null: DataFrame, scale: str = "millibans") -> DataFrame:
    """(org_a, org_b, codon_a, codon_b, n, own, score) for all pairs of codons, and `expected`, the mean score of the counted
    pairs, for each pair of organisms. own: the score of codon_a alone.

    pairs: (org_a, org_b, codon_a, codon_b, n), null: (organism, codon_idx, n). A pair's score is that of codon_a against
    org_a's null plus that of codon_b given codon_a against org_b's. Stops: 0 for two of them, NEVER for one. Scores of
    pairs that occur where the null has none are ALWAYS, never wrapped around."""
    coding = pairs.where(~is_stop("codon_a") & ~is_stop("codon_b"))
    orgs = ["org_a", "org_b"]
    first = coding.groupBy(*orgs, F.col("codon_a").alias("codon")).agg(F.sum("n").alias("n"))
    null_of = lambda org, codon: null.select(F.col("organism").alias(org), F.col("codon_idx").alias(codon), "n")
    own = score_table(first, null_of("org_a", "codon"), orgs, "codon", 64, ["org_a"], scale).select(*orgs, F.col("codon").alias("codon_a"), F.col("score").alias("_from"))
    # Codons never seen as the first still have a row: all zero counts give 0 or NEVER by the null.
    grid = coding.select(*orgs).distinct().withColumn("codon_a", F.explode(F.sequence(F.lit(0), F.lit(63)))).withColumn("codon_b", F.explode(F.sequence(F.lit(0), F.lit(63))))
    full = join_null_safe(grid, coding.groupBy(*orgs, "codon_a", "codon_b").agg(F.sum("n").alias("n")), [*orgs, "codon_a", "codon_b"], "left").fillna(0, ["n"])
    full = join_null_safe(full, null_of("org_b", "codon_b").withColumnRenamed("n", "n0"), ["org_b", "codon_b"], "left").fillna(0, ["n0"])
    per = Window.partitionBy(*orgs, "codon_a")
    given = log_odds(F.col("n"), F.col("n0"), F.sum("n").over(per), F.sum("n0").over(per), scale)
    scored = join_null_safe(full.withColumn("_given", given), own, [*orgs, "codon_a"])
    a, b = is_stop("codon_a"), is_stop("codon_b")
    total = F.col("_given").cast("bigint") + F.col("_from")
    score = F.when(a & b, 0).when(a | b, NEVER).when((F.col("_given") == NEVER) | (F.col("_from") == NEVER), NEVER).otherwise(F.least(total, F.lit(ALWAYS))).cast("int")
    out = scored.select(*orgs, "codon_a", "codon_b", "n", F.col("_from").alias("own"), score.alias("score"))
    whole = Window.partitionBy(*orgs)
    counted = F.when((F.col("score") != NEVER) & ~a & ~b, F.col("n") * F.col("score").cast("double")).otherwise(0.0)
    return out.withColumn("expected", F.sum(counted).over(whole) / F.sum(F.when(~a & ~b, F.col("n")).otherwise(0)).over(whole))


def markov(pairs: DataFrame, states: int = 64) -> DataFrame:
    """(org_a, org_b, codon_a, codon_b, p): substitution probabilities of the counted pairs with 1 added to every count;
    pairs that never occur have 1 / (row total + states)."""
    per = Window.partitionBy("org_a", "org_b", "codon_a")
    return pairs.withColumn("p", (F.col("n") + 1) / (F.sum("n").over(per) + states))
