"""Queries that reconstruct ancestral introns from the aligned proteins, their genes and the tree. The tables hold no contigs:
a gene's piece is made of its protein's stand-in coding sequence, with introns from GT to AG and flanks between."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exonia.functions.seq import reverse_complement
from exonia.operators import counting, genes, homology, scoring, trees
from exonia.plans import alignments as AL
from exonia.plans import sequences as SQ
from exonia.plans.views import models
from exonia.session import evaluated, stored, table
from exonia.sources import report_lines

QUERIES: dict = {}
ORACLE: dict = {}
FLANK = 100
FILLER = "CATTCAGGCTTACCGTATCTGCCAATGTTC"


def query(f):
    QUERIES[f.__name__] = f
    return f


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(alignment, seq_idx, organism, strand, exons, residues, dna, origin)"""
    ex, st = F.col("exons"), F.col("strand")
    own = models(spark, sf_dir).select(F.col("row_id").alias("gene_row"), "strand", "exons")
    m = AL.members(spark, sf_dir).where("organism is not null and residues is not null").join(own, "gene_row")
    rows = evaluated(m, coding=AL.coding(), before=genes.length_before(ex, st), gaps=F.transform(genes.introns(ex, st), lambda i: i["length"]))
    # Exons and the introns behind them in transcription order; coding bases beyond the protein are unknown.
    reverse = genes.is_reverse()
    at = F.zip_with(ex, "before", lambda e, n: F.struct(n.alias("n"), (e["end"] - e["start"]).alias("len")))
    order = F.when(reverse, F.reverse(at)).otherwise(at)
    filled = F.rpad(F.col("coding"), genes.coding_length(ex), "N")
    rows = evaluated(rows, order=order, filled=filled)
    exon_texts = F.transform("order", lambda x: F.substring(F.col("filled"), x["n"] + 1, x["len"]))
    intron_texts = F.transform("gaps", lambda n: F.when(n >= 4, F.concat(F.lit("GT"), F.rpad(F.lit("A"), n - 4, FILLER), F.lit("AG"))).otherwise(F.rpad(F.lit("A"), n, FILLER)))
    text = F.array_join(F.zip_with(exon_texts, intron_texts, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    whole = F.concat(F.rpad(F.lit("A"), F.lit(FLANK), FILLER), text, F.rpad(F.lit("A"), F.lit(FLANK), FILLER))
    dna = F.when(reverse, reverse_complement(whole)).otherwise(whole)
    return rows.select("alignment", "seq_idx", "organism", "strand", "exons", "residues", dna.alias("dna"), (F.get("exons", 0)["start"] - FLANK).alias("origin"))


def scores_of(spark: SparkSession, sf_dir: str) -> homology.Scores:
    """Scores for the tree's organisms: at most (organisms squared) * 4096 numbers, for at most MAX_ORGANISMS. They are a table set's
    statistics model, made once a session; both of its parts are computed at the same time."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SCORES:
        _SCORES.clear()
        _SCORES[key] = _scores(spark, sf_dir)
    return _SCORES[key]


MAX_ORGANISMS = 64
_SCORES: dict[tuple[str, str], homology.Scores] = {}


def _scores(spark: SparkSession, sf_dir: str) -> homology.Scores:
    names = AL.organism_names(spark, sf_dir)
    index = {n: i for i, n in enumerate(names)}
    if len(names) > MAX_ORGANISMS:
        raise ValueError(f"scores of more than {MAX_ORGANISMS} organisms aren't sent to tasks")
    subst = np.full((len(names), len(names), 64, 64), scoring.NEVER, np.int32)
    expected = np.zeros((len(names), len(names)))
    ordered = F.array_sort(F.collect_list(F.struct("codon_a", "codon_b", "score")))
    # Both parts need the null counts, which are the most work.
    null = stored(SQ.null_codon_counts(spark, sf_dir), "null_codons")
    middle_counts = SQ.codon_counts(spark, sf_dir).where("class = 'middle'")
    codon_scores = scoring.score_table(middle_counts, counting.combined(null), ["organism", "class"], "codon_idx", 64, ["organism"])
    rows = AL._substitutions(spark, sf_dir, null).groupBy("org_a", "org_b").agg(F.first("expected").alias("expected"), F.transform(ordered, lambda x: x["score"]).alias("scores"))
    with ThreadPoolExecutor(2) as at_once:
        pairs = at_once.submit(rows.collect)
        codons = at_once.submit(codon_scores.collect)
    for r in pairs.result():
        at = index[r.org_a], index[r.org_b]
        subst[at] = np.array(r.scores).reshape(64, 64)
        expected[at] = r.expected or 0.0
    middle = np.zeros((len(names), 64), np.int64)
    for r in codons.result():
        if (k := int(r.organism[1:])) < len(names):
            middle[k, r.codon_idx] = r.score
    return homology.Scores(names, subst, expected, middle)


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = trees.collected(table(spark, sf_dir, "phylo_edge"))
    return homology.reconstructed(members(spark, sf_dir), scores_of(spark, sf_dir), tree)


@query
def intron_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6, W7, W8, D17, D18, A19, G1, G2"""
    return homology.part(_run(spark, sf_dir), "contexts")


@query
def ancestral_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node's state, and of leaves the sites in the organism's coordinates, their dinucleotides and
    their distance from the annotation."""
    return homology.part(_run(spark, sf_dir), "nodes")


@query
def gene_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T9"""
    return homology.part(_run(spark, sf_dir), "edits")


@query
def unjudged_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organisms with several sequences in an alignment, which the queries above leave out for that."""
    return homology.doubled(members(spark, sf_dir), AL.organism_names(spark, sf_dir))


@query
def event_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each kind of event occurs on each branch."""
    kind = F.regexp_replace("event", r"\(\d+\)", "")
    return ancestral_states(spark, sf_dir).groupBy("node", kind.alias("event")).agg(F.count("*").alias("n"))


@query
def history_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7, K8, K9: ancestral, history and edit lines, context by context."""
    tree = trees.collected(table(spark, sf_dir, "phylo_edge"))
    rows = stored(_run(spark, sf_dir), "history")
    nodes = homology.part(rows, "nodes")
    return report_lines.in_order(report_lines.ancestral_lines(nodes, tree), report_lines.history_lines(nodes), report_lines.edit_lines(homology.part(rows, "edits")))
