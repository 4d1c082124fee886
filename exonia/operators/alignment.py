"""Aligned proteins: where codons and introns fall in the columns, codon pairs, and gap statistics.

A sequence is a row (alignment, organism, residues, ...). All columns of a sequence stay in its row; only whole sequences are
shuffled, and counted things after that."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exonia.functions.seq import codon_index, column_code, from_column_code, is_regular
from exonia.session import evaluated

#: Index of a gap or an ambiguous codon in pair counts.
NO_CODON = 64


def letters(s: Column | str) -> Column:
    return F.split(F.col(s) if isinstance(s, str) else s, "")


def positions_where(chars: Column, test) -> Column:
    """The columns, in order, whose character passes the test."""
    at = F.transform(chars, lambda c, i: F.when(test(c), i))
    return F.filter(at, lambda i: i.isNotNull())


def placed_introns(sequences: DataFrame, residues: str = "residues", offsets: str = "offsets") -> DataFrame:
    """sequences with `introns`, an array of (col, phase) of the introns given by their coding offsets: the column of the
    codon that holds the last base before the intron, and how many of its bases (1 to 3) come before it. Every character
    but a gap takes a codon here. Introns beyond the aligned part are left out."""
    rows = evaluated(sequences, _columns=positions_where(letters(residues), lambda c: c != "-"))
    place = lambda o: F.struct(F.get("_columns", F.floor((o - 1) / 3).cast("int")).alias("col"), ((o - 1) % 3 + 1).cast("int").alias("phase"))
    found = F.transform(F.filter(offsets, lambda o: o > 0), place)
    return evaluated(rows, introns=F.filter(found, lambda x: x["col"].isNotNull())).drop("_columns")


def shares_codon(offsets: Column) -> Column:
    """Whether two introns fall into one codon."""
    codons = F.transform(F.filter(offsets, lambda o: o > 0), lambda o: F.floor((o - 1) / 3))
    return F.size(F.array_distinct(codons)) < F.size(codons)


def aligned_codons(sequences: DataFrame, residues: str = "residues", coding: str = "coding") -> DataFrame:
    """sequences with `codons`: the codon index of each column, null for gaps, unknown residues (which take no codon here),
    ambiguous codons and where the coding sequence has ended or is null."""
    triplets = F.transform(F.regexp_extract_all(F.coalesce(coding, F.lit("")), F.lit("(.{3})"), F.lit(1)), codon_index)
    rows = evaluated(sequences, _triplets=triplets, _taken=positions_where(letters(residues), is_regular))
    # The place of a column among those that take a codon is its codon's number; get() gives null for the others' -1.
    columns = F.transform(letters(residues), lambda c, i: F.get("_triplets", F.array_position("_taken", i) - 1))
    return evaluated(rows, codons=columns).drop("_triplets", "_taken")


def complete(sequences: DataFrame, organisms: int, prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """(alignment, rows) of the alignments with exactly one sequence for each of so many organisms; rows are structs of the
    sequence's other columns, ordered by organism. A second sequence of an organism rules an alignment out before
    anything is gathered, so that no more than `organisms` rows come together. prepare: what is made of the sequences
    that are left, before they are gathered."""
    known = sequences.where(F.col("organism").isNotNull())
    per = known.groupBy("alignment", "organism").agg(F.count("*").alias("_n"))
    fit = per.groupBy("alignment").agg(F.count("*").alias("_o"), F.max("_n").alias("_m")).where((F.col("_o") == organisms) & (F.col("_m") == 1)).select("alignment")
    kept = prepare(known.join(fit, "alignment", "left_semi"))
    rest = [c for c in kept.columns if c not in ("alignment", "organism")]
    return kept.groupBy("alignment").agg(F.array_sort(F.collect_list(F.struct("organism", *rest))).alias("rows"))


def codon_columns(alignments: DataFrame, codons: str = "codons") -> DataFrame:
    """(code, n): how often each column of codons occurs, as text with one character an organism in alphabetical order."""
    rows = F.col("rows")
    width = F.array_max(F.transform(rows, lambda r: F.size(r[codons])))
    columns = F.transform(F.sequence(F.lit(0), width - 1), lambda c: column_code(F.transform(rows, lambda r: F.get(r[codons], c))))
    return alignments.where(width > 0).select(F.explode(columns).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def pair_counts(columns: DataFrame, organisms: list[str]) -> DataFrame:
    """(org_a, org_b, codon_a, codon_b, n) for all ordered pairs of different organisms; 64 stands for no codon."""
    names = F.array(*map(F.lit, organisms))
    rows = evaluated(columns, codons=F.transform(from_column_code("code"), lambda i: F.coalesce(i, F.lit(NO_CODON))))
    a = rows.select("n", "codons", F.posexplode(names).alias("_a", "org_a"))
    b = a.select("n", "codons", "_a", "org_a", F.posexplode(names).alias("_b", "org_b")).where("_a <> _b")
    return b.groupBy("org_a", "org_b", F.get("codons", F.col("_a")).alias("codon_a"), F.get("codons", F.col("_b")).alias("codon_b")).agg(F.sum("n").alias("n"))


def gap_states(a: Column | str, b: Column | str) -> Column:
    """One character a column of two aligned sequences: M both have a residue, I the first has a gap, D the second, . both."""
    return F.array_join(F.zip_with(letters(a), letters(b), lambda x, y: F.when((x == "-") & (y == "-"), ".").when(x == "-", "I").when(F.coalesce(y, F.lit("-")) == "-", "D").otherwise("M")), "")


def sequence_pairs(sequences: DataFrame, columns: list[str]) -> DataFrame:
    """The pairs of sequences of an alignment with seq_idx of the first above that of the second, as columns with _1 and _2.
    An alignment has at most one sequence of each seq_idx, so a sequence meets as many as there are organisms."""
    side = lambda k: sequences.select("alignment", *(F.col(c).alias(f"{c}_{k}") for c in ["seq_idx", *columns]))
    return side(1).join(side(2), "alignment").where("seq_idx_1 > seq_idx_2")


def run_lengths(pairs: DataFrame, keys: list[str], states: str = "states") -> DataFrame:
    """(keys..., kind, length, n): the runs of matches, insertions and deletions; columns with two gaps are passed over."""
    runs = F.regexp_extract_all(F.replace(states, F.lit("."), F.lit("")), F.lit("(M+|I+|D+)"), F.lit(1))
    each = pairs.select(*keys, F.explode(runs).alias("_r"))
    return each.groupBy(*keys, F.left("_r", F.lit(1)).alias("kind"), F.length("_r").alias("length")).agg(F.count("*").alias("n"))


def gap_distances(states: Column, introns: Column) -> Column:
    """(phase, up, down) of the introns (col, phase) of one sequence of a pair: how far the nearest gaps are.

    Within a match, up is the place in the run from 1, down the rest of the run behind the intron. At a gap both are 0;
    after the last base of a codon at a gap (phase 3) down is 0 if the next column is a gap too, the length of the run if
    it is a match, and null if there is no next column."""
    plain = lambda s: F.replace(s, F.lit("."), F.lit(""))

    def one(x: Column) -> Column:
        here = F.substring(states, x["col"] + 1, F.lit(1))
        up = F.length(F.regexp_extract(plain(F.left(states, x["col"] + 1)), "M+$", 0))
        behind = plain(F.substring(states, x["col"] + 2, F.length(states)))
        run = F.length(F.regexp_extract(behind, "^M*", 0))
        matched = F.when(x["phase"] == 3, run).otherwise(run + 1)
        at_gap = F.when(x["phase"] < 3, 0).when(F.length(behind) > 0, run)
        return F.struct(x["phase"].alias("phase"), up.alias("up"), F.when(here == "M", matched).otherwise(at_gap).alias("down"))

    return F.transform(introns, one)
