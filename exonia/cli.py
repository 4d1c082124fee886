"""Commands: extract-annotations, collect-statistics, check-sites, count-gaps, genomic-context.

All of them read files named on the command line and write folders."""

from __future__ import annotations

import argparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exonia.functions import seq as S
from exonia.operators import alignment, counting, genes, homology, lengths, parsimony, scoring
from exonia.session import build_session, evaluated, few, stored
from exonia.sources import fasta, model_text, newick, report_lines, text_lines

#: Identifier key of each dialect.
GFF_KEYS = {"gff3": "ID", "gtf": "transcript_id", "jgi": "proteinId"}
FLANK = 100


def annotated(spark: SparkSession, spec: str, organisms: DataFrame | None = None, layout: str | dict = "combined") -> DataFrame:
    """Gene models of annotation tables, of the known organisms, the last of each name, without faulty ones."""
    out = None
    for k, (organism, path) in enumerate(fasta.named_files(spec)):
        lines = spark.read.text(fasta.local_path(spark, path))
        part = text_lines.read_table(lines, layout, organism or None, organisms).withColumn("_k", F.lit(k))
        out = part if out is None else out.unionByName(part)
    good = out.where("problem is null or problem = 'short'").withColumnRenamed("gene", "accno")
    ordered = good.withColumn("_n", F.monotonically_increasing_id())
    return genes.last_wins(ordered, ["organism", "accno"], ["_k", "_n"]).drop("_k", "_n")


def gff_annotated(spark: SparkSession, kind: str, spec: str, feature: str, key: str | None, prefix: str | None) -> DataFrame:
    out = None
    for organism, path in fasta.named_files(spec, required=True):
        rows = text_lines.read_gff(spark.read.text(fasta.local_path(spark, path)), organism)
        before = None if prefix == "|" else F.lit(prefix or "")
        part = text_lines.gff_models(rows.withColumn("dialect", F.lit(kind)), feature, key or GFF_KEYS[kind], before)
        out = part if out is None else out.unionByName(part)
    clean = genes.sanitised(out.withColumnRenamed("ident", "accno"))
    return clean.where("problem is null or problem = 'short'").select("organism", "chrom", "accno", "strand", "exons")


def with_sequence(models: DataFrame, genome: DataFrame) -> DataFrame:
    """Models with `dna`, their piece of contig with flanks, and exons counted from its start (`local`).

    A contig's sequence is read block by block, so that contigs with many genes are spread."""
    size = genome.select("organism", "chrom", F.length("seq").alias("n_bases"))
    on = models.join(size, ["organism", "chrom"])
    lo = F.greatest(F.get("exons", 0)["start"] - FLANK, F.lit(0))
    hi = F.least(F.element_at("exons", -1)["end"] + FLANK, F.col("n_bases"))
    ranges = on.withColumns({"start": lo, "end": hi})
    got = counting.slices(ranges, counting.sequence_blocks(genome), ["accno"]).select("organism", "accno", F.col("start").alias("origin"), F.col("end").alias("stop"), F.col("text").alias("dna"))
    rows = on.join(got, ["organism", "accno"])
    return evaluated(rows, local=F.transform("exons", lambda e: genes.exon(e["start"] - F.col("origin"), e["end"] - F.col("origin"))))


def extract_annotations(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    genome = fasta.genomes(spark, a.genomes)
    kind = {"gp": "genepred"}.get(a.kind, a.kind)
    if kind == "genepred":
        models = annotated(spark, a.annotations, genome.select("organism"), "genepred")
    elif kind in GFF_KEYS or kind == "gff":
        if kind == "gff" and not a.ident:
            raise SystemExit("gff needs --ident")
        models = gff_annotated(spark, kind, a.annotations, a.feature, a.ident, a.prefix)
    else:
        raise SystemExit(f"unknown kind of annotation: {a.kind}")
    known = models.join(genome.select("organism", "chrom"), ["organism", "chrom"], "left_semi")
    rows = known.orderBy("organism", "accno").select(text_lines.annotation_line(F.col("accno")).alias("value"))
    return spark.createDataFrame([("\t".join(text_lines.HEADER),)], "value string").unionByName(rows)


def sequences_of(spark: SparkSession, files: list[str], models: DataFrame) -> DataFrame:
    """The alignments' sequences that have a gene, with its columns."""
    proteins = None
    for path in files:
        part = fasta.proteins(spark, path)
        proteins = part if proteins is None else proteins.unionByName(part)
    got = genes.with_gene(proteins, models).where(F.col("gene_row").isNotNull())
    return got.select("alignment", "seq_idx", "seq_id", "defline", "residues", "gene_row.*")


def statistics(spark: SparkSession, models: DataFrame, aligned: DataFrame) -> dict[str, DataFrame]:
    """The tables of a statistics model; models with `dna` and `local`."""
    rows = models.select("organism", "strand", F.col("local").alias("exons"), F.col("dna").alias("seq"))
    organisms = few(models.select("organism").distinct().orderBy("organism"), "organism")
    cut = lambda rows: evaluated(rows, coding=genes.cds(F.col("dna"), F.col("local"), F.col("strand")))
    codons = lambda rows: alignment.aligned_codons(cut(rows)).select("alignment", "organism", "codons")
    columns = alignment.codon_columns(alignment.complete(aligned.where("residues is not null"), len(organisms), codons))
    tables: dict[str, list[DataFrame]] = {"motifs": [], "edges": [], "codons": []}
    for donor, site in ((True, "donor"), (False, "acceptor")):
        real = counting.site_texts(rows, donor)
        for kind, motif, edge in (("real", counting.motif_counts(real), counting.edge_counts(real)), ("null", counting.null_motif_counts(rows, donor), counting.null_edge_counts(rows, donor))):
            name = {"site": F.lit(site), "kind": F.lit(kind)}
            tables["motifs"].append(motif.withColumns(name))
            tables["edges"].append(edge.withColumns(name))
    for kind, counts in (("real", counting.codon_counts(rows)), ("null", counting.null_codon_counts(rows))):
        tables["codons"].append(counts.withColumn("kind", F.lit(kind)))
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    histogram = genes.length_histograms(models).where("kind = 'intron_length'")
    return {
        "organisms": spark.createDataFrame([(o, k) for k, o in enumerate(organisms)], model_text.SCHEMAS["organisms"]),
        "columns": columns,
        "lengths": lengths.fitted(histogram),
        **{n: union(p) for n, p in tables.items()},
    }


def scores_of(model: dict[str, DataFrame]) -> homology.Scores:
    """Scores from a model, for at most 64 organisms."""
    names = [r.organism for r in model["organisms"].orderBy("place").limit(65).collect()]
    if len(names) > 64:
        raise ValueError("scores of more than 64 organisms aren't sent to tasks")
    index = {n: i for i, n in enumerate(names)}
    null = counting.combined(model["codons"].where("kind = 'null'"))
    pairs = alignment.pair_counts(model["columns"], names).where("codon_a < 64 and codon_b < 64")
    subst = np.full((len(names), len(names), 64, 64), scoring.NEVER, np.int64)
    expected = np.zeros((len(names), len(names)))
    for r in scoring.substitution_scores(pairs, null).where(f"score <> {scoring.NEVER}").toLocalIterator():
        subst[index[r.org_a], index[r.org_b], r.codon_a, r.codon_b] = r.score
        expected[index[r.org_a], index[r.org_b]] = r.expected or 0.0
    middle = np.zeros((len(names), 64), np.int64)
    real = model["codons"].where("kind = 'real' and class = 'middle'").select("organism", "codon_idx", "n")
    for r in scoring.score_table(real, null, ["organism"], "codon_idx", 64).collect():
        middle[index[r.organism], r.codon_idx] = r.score
    return homology.Scores(names, subst, expected, middle)


def load_model(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return model_text.read(spark, path) if path.endswith((".txt", ".txt.gz", ".model", ".gz")) else model_text.load(spark, path)


def prepared(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    genome = fasta.genomes(spark, a.genomes)
    models = with_sequence(annotated(spark, a.annotations, genome.select("organism"), getattr(a, "layout", "combined")), genome)
    return models, sequences_of(spark, a.alignments, models)


def collect_statistics(spark: SparkSession, a: argparse.Namespace) -> None:
    model = statistics(spark, *prepared(spark, a))
    if a.out.endswith(".txt"):
        model_text.write(model, a.out)
    else:
        model_text.save(model, a.out)


def check_sites(spark: SparkSession, a: argparse.Namespace) -> None:
    _, aligned = prepared(spark, a)
    root = newick.trees(open(a.tree).read())[0]
    tree = [(name, parent) for _, name, parent, _, _ in newick.edges(root)]
    rows = aligned.select("alignment", "organism", "strand", "exons", "residues", "dna", "origin")
    p = parsimony.Penalties(a.loss, a.gain, a.shift, a.annot)
    scores = scores_of(load_model(spark, a.model))
    homology.doubled(rows, list(scores.index)).write.mode("overwrite").parquet(f"{a.out}/unjudged")
    every = stored(homology.reconstructed(rows, scores, tree, p), "history")
    for what in homology.PARTS:
        homology.part(every, what).write.mode("overwrite").parquet(f"{a.out}/{what}")
    nodes, edits = homology.part(every, "nodes"), homology.part(every, "edits")
    lines = report_lines.in_order(report_lines.ancestral_lines(nodes, tree), report_lines.history_lines(nodes), report_lines.edit_lines(edits), report_lines.ancestral_header(tree), report_lines.file_lines(edits, a.save) if a.save else None)
    lines.select("value").write.mode("overwrite").text(f"{a.out}/report")
    if a.showali:
        dumped(aligned).write.mode("overwrite").text(f"{a.out}/alignments")
    if a.save:
        save_edited(spark, spark.read.parquet(f"{a.out}/edits"), aligned, a.save)


def dumped(aligned: DataFrame) -> DataFrame:
    """Lines of each alignment's genes, introns and columns."""
    own = genes.introns(F.col("exons"), F.col("strand"))
    rows = evaluated(
        aligned.where("residues is not null"), coding=genes.cds(F.col("dna"), F.col("local"), F.col("strand")), offsets=F.transform(own, lambda i: i["cds_offset"]),
        cut=genes.intron_sequences(F.col("dna"), F.col("local"), F.col("strand")), taken=alignment.positions_where(alignment.letters("residues"), S.is_regular),
    )
    walked = alignment.placed_introns(alignment.aligned_codons(rows))
    no = F.lit(0)
    parts = [
        report_lines.gene_lines(rows).select("alignment", no.alias("part"), "seq_idx", no.alias("at"), "value"),
        report_lines.intron_lines(rows).select("alignment", F.lit(1).alias("part"), "seq_idx", F.col("nth").alias("at"), "value"),
        report_lines.alignment_lines(walked).select("alignment", F.lit(2).alias("part"), no.alias("seq_idx"), F.col("col").alias("at"), "value"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).orderBy("alignment", "part", "seq_idx", "at").select("value")


def save_edited(spark: SparkSession, edits: DataFrame, aligned: DataFrame, folder: str) -> None:
    """The genes after all edits of their alignment: GFF3 lines by organism, and their proteins."""
    note = F.concat(F.col("edit"), F.lit("("), F.concat_ws("..", F.col("donor").cast("string"), F.col("acceptor").cast("string"), F.col("shift").cast("string")), F.lit(")"))
    last = edits.groupBy("alignment", "organism").agg(
        F.max_by(F.struct("exon_starts", "exon_ends"), F.struct("ctx", F.length("edit"))).alias("_x"), F.array_join(F.array_sort(F.collect_list(F.concat(F.lpad(F.col("ctx").cast("string"), 9, "0"), note))), ",").alias("_log")
    )
    rows = last.select("alignment", "organism", F.regexp_replace("_log", "(^|,)[0-9]{9}", "$1").alias("log"), genes.zipped(F.split("_x.exon_starts", ","), F.split("_x.exon_ends", ",")).alias("new"))
    both = aligned.join(rows, ["alignment", "organism"])
    gff = text_lines.gff3_lines(F.col("accno"), "exonia", "new", note=F.concat(F.lit(";reannotate="), F.col("log")))
    both.select("organism", F.explode(gff).alias("value")).write.mode("overwrite").partitionBy("organism").text(f"{folder}/gff")
    local = F.transform("new", lambda e: genes.exon(e["start"] - F.col("origin"), e["end"] - F.col("origin")))
    protein = F.array_join(F.transform(counting.triplets(genes.cds(F.col("dna"), local, F.col("strand"))), lambda c: F.coalesce(S.residue_of(S.codon_index(c)), F.lit("X"))), "")
    record = text_lines.fasta(F.concat(F.col("accno"), F.lit(" /reannotate="), F.col("log")), protein)
    both.select("organism", record.alias("value")).write.mode("overwrite").partitionBy("organism").text(f"{folder}/fasta")


def count_gaps(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Report lines: tallies of phases, and runs and gaps of all pairs of organisms."""
    _, aligned = prepared(spark, a)
    rows = evaluated(aligned, offsets=F.transform(genes.introns(F.col("exons"), F.col("strand")), lambda i: i["cds_offset"]))
    return report_lines.in_gap_order(report_lines.gap_lines(alignment.placed_introns(rows)))


def genomic_context(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Each aligned gene's surroundings as FASTA; sequences without a gene are left out."""
    _, aligned = prepared(spark, a)
    text = F.when(F.col("strand") == "-", S.reverse_complement("dna")).otherwise(F.col("dna"))
    has = S.tag("defline", "organism").isNotNull()
    defline = F.concat(F.col("defline"), F.format_string(" /region=%s:%d..%d /strand=%s", "chrom", F.col("origin") + 1, "stop", "strand"), F.when(has, "").otherwise(F.concat(F.lit(" /organism="), F.col("organism"))))
    return aligned.select(text_lines.fasta(defline, text).alias("value"))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="exonia", description=__doc__)
    p.add_argument("--master", default="local[*]")
    sub = p.add_subparsers(dest="command", required=True)
    x = sub.add_parser("extract-annotations")
    x.add_argument("kind", help="gff3, gtf, jgi, gff, genepred or gp")
    x.add_argument("genomes")
    x.add_argument("annotations")
    x.add_argument("--feature", default="CDS")
    x.add_argument("--ident")
    x.add_argument("--prefix", default="|")
    for name in ("collect-statistics", "check-sites", "count-gaps", "genomic-context"):
        x = sub.add_parser(name)
        x.add_argument("genomes")
        x.add_argument("annotations")
        if name == "check-sites":
            x.add_argument("model")
            x.add_argument("tree")
            for option, default in (("loss", 5), ("gain", 12), ("shift", 5), ("annot", 1)):
                x.add_argument(f"--{option}", type=int, default=default)
            x.add_argument("--save")
            x.add_argument("--showali", action="store_true", help="also write the alignments' genes, introns and columns")
        x.add_argument("alignments", nargs="+")
        for option, default in (("chromo", 0), ("gene", 2), ("strand", 4), ("organism", 9)):
            x.add_argument(f"--colidx-{option}", type=int, default=default)
        x.add_argument("--columns-exon", default="11,12")
    for x in sub.choices.values():
        x.add_argument("-o", "--out", required=True)
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    if hasattr(a, "columns_exon"):
        a.layout = {"chrom": a.colidx_chromo, "gene": a.colidx_gene, "strand": a.colidx_strand, "organism": a.colidx_organism, "exons": tuple(map(int, a.columns_exon.split(",")))}
    spark = build_session("exonia", a.master)
    result = {"extract-annotations": extract_annotations, "collect-statistics": collect_statistics, "check-sites": check_sites, "count-gaps": count_gaps, "genomic-context": genomic_context}[a.command](spark, a)
    if result is not None:
        result.write.mode("overwrite").text(a.out)


if __name__ == "__main__":
    main()
