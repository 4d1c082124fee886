"""Annotation formats: tables of gene models and GFF dialects, read to models and written as lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exonia.operators import genes, packed
from exonia.operators.records import IDENTIFIER

#: The header of the combined annotation table, and the columns of two table layouts.
HEADER = ("seq", "gene", "accno", "CDS", "strand", "length", "ipos", "ilen", "gi", "organism", "leftmost", "exon.starts", "exon.ends")
LAYOUTS = {
    "combined": {"chrom": 0, "gene": 2, "strand": 4, "organism": 9, "exons": (11, 12)},
    "genepred": {"chrom": 1, "gene": 0, "strand": 2, "organism": None, "exons": (8, 9)},
}


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _intron_lists(own: Column) -> tuple[Column, Column]:
    """The coding offsets and the lengths of introns as lists; 00 for none."""
    listed = lambda part: F.when(F.size(own) == 0, "00").otherwise(F.array_join(F.transform(own, lambda i: i[part].cast("string")), ","))
    return listed("cds_offset"), listed("length")


def intron_tags(exons: Column, strand: Column) -> Column:
    """What a translated gene's defline tells of its introns."""
    offsets, lengths = _intron_lists(genes.introns(exons, strand))
    return F.concat(F.lit("{i "), offsets, F.lit(" i} /intron-length="), lengths)


def annotation_line(name: Column, exons: str | Column = "exons", strand: str | Column = "strand", chrom: str | Column = "chrom", organism: str | Column = "organism") -> Column:
    """A line of the combined annotation table; null parts are left out of it."""
    ex, st = _col(exons), _col(strand)
    own, length = genes.introns(ex, st), genes.coding_length(ex)
    offsets, lengths = _intron_lists(own)
    residues = F.when(length % 3 == 0, (length / 3).cast("int").cast("string")).otherwise((length / F.lit(3.0)).cast("string"))
    ends = lambda part: F.array_join(F.transform(ex, lambda e: e[part].cast("string")), ",")
    return F.concat_ws("\t", _col(chrom), name, name, F.lit("full"), st, residues, offsets, lengths, name, _col(organism), (F.get(ex, 0)["start"] + 1).cast("string"), ends("start"), ends("end"))


def known_gene_line(name: Column, exons: str | Column = "exons", strand: str | Column = "strand", chrom: str | Column = "chrom") -> Column:
    """A line of the knownGene layout; each value of a list has a comma after it."""
    ex = _col(exons)
    first, last = F.get(ex, 0)["start"].cast("string"), F.element_at(ex, -1)["end"].cast("string")
    listed = lambda part: F.array_join(F.transform(ex, lambda e: F.concat(e[part].cast("string"), F.lit(","))), "")
    return F.concat_ws("\t", name, _col(chrom), _col(strand), first, last, first, last, F.size(ex).cast("string"), listed("start"), listed("end"))


def gff3_lines(name: Column, source: str, exons: str | Column = "exons", strand: str | Column = "strand", chrom: str | Column = "chrom", note: Column | None = None) -> Column:
    """The CDS lines of a model, an array; note is put behind the identifier."""
    ex, st = _col(exons), _col(strand)
    attributes = F.concat(F.lit("ID="), name) if note is None else F.concat(F.lit("ID="), name, note)
    return F.zip_with(
        ex, genes.exon_phases(ex, st), lambda e, p: F.concat_ws("\t", _col(chrom), F.lit(source), F.lit("CDS"), (e["start"] + 1).cast("string"), e["end"].cast("string"), F.lit("."), st, p.cast("string"), attributes)
    )


def fasta(defline: Column, sequence: Column, width: int = 50) -> Column:
    """A FASTA record, the sequence in lines of the given width."""
    return F.concat(F.lit(">"), defline, F.lit("\n"), F.regexp_replace(sequence, f"(.{{{width}}})(?!$)", "$1\n"))


def read_table(lines: DataFrame, layout: dict | str = "combined", organism: str | None = None, organisms: DataFrame | None = None) -> DataFrame:
    """(organism, chrom, gene, strand, exons, problem) of the lines (`value`) of a tab-separated table of gene models.

    Lines that begin with # and blank lines are skipped. organism: that of every line, where the table has none.
    organisms: rows of other organisms are dropped. Lists may have a comma at their end. Lines with too few columns or
    unequal lists come out with problem `unreadable` and null exons, the rest as by sanitised()."""
    at = LAYOUTS[layout] if isinstance(layout, str) else layout
    c = F.split(F.rtrim("value", F.lit("\r")), "\t")
    rows = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(
        (F.lit(organism) if organism is not None or at["organism"] is None else F.get(c, at["organism"])).alias("organism"),
        F.get(c, at["chrom"]).alias("chrom"),
        F.get(c, at["gene"]).alias("gene"),
        F.get(c, at["strand"]).alias("strand"),
        *(F.filter(F.split(F.get(c, i), ","), lambda x: F.trim(x) != "").alias(f"_{n}") for n, i in zip("se", at["exons"], strict=True)),
    )
    models = genes.sanitised(rows.withColumn("exons", genes.zipped(F.col("_s"), F.col("_e"))).drop("_s", "_e"))
    models = models.withColumn("problem", F.when(F.col("exons").isNull(), "unreadable").otherwise(F.col("problem")))
    return models if organisms is None else models.join(organisms.select("organism").distinct(), "organism", "left_semi")


def read_gff(lines: DataFrame, organism: str) -> DataFrame:
    """The nine columns of GFF lines (`value`) as in the table gff; comments, blank and short lines are left out."""
    c = F.split(F.trim(F.col("value"), F.lit(" \t\r\n")), "\t")
    return lines.where(~F.col("value").startswith("#")).where(F.size(c) >= 9).select(
        F.lit(organism).alias("organism"), F.get(c, 0).alias("gff_seqid"), F.get(c, 2).alias("gff_type"), F.get(c, 3).try_cast("int").alias("gff_start"), F.get(c, 4).try_cast("int").alias("gff_end"), F.get(c, 6).alias("gff_strand"), F.get(c, 8).alias("gff_attr")
    )


def gff_identified(gff: DataFrame, key: str | None = None, prefix: Column | None = None) -> DataFrame:
    """gff's rows with `ident`, the gene named by the dialect's key (or the given one), normalised and with a prefix, the
    organism and | if none is given. Rows whose field lacks the key, or has it empty, are left out; the first one counts."""
    wanted = F.lit(key) if key else F.create_map(*(F.lit(x) for kv in IDENTIFIER.items() for x in kv))[F.col("dialect")]
    pattern = packed.piece_pattern(";|")
    pieces = F.regexp_extract_all("gff_attr", F.lit(pattern), F.lit(0))
    own = F.get(F.filter(pieces, lambda p: F.regexp_extract(p, pattern, 1) == wanted), 0)
    value = F.concat(*(F.regexp_extract(own, pattern, g) for g in (2, 3)), F.rtrim(F.concat(*(F.regexp_extract(own, pattern, g) for g in (4, 5))), F.lit(" \t\r\n")))
    before = F.concat(F.col("organism"), F.lit("|")) if prefix is None else prefix
    return gff.where(F.col("gff_attr").isNotNull()).withColumn("_raw", value).where(F.col("_raw") != "").withColumn("ident", genes.normal_ident(F.col("_raw"), before)).drop("_raw")


def gff_models(gff: DataFrame, feature: str = "CDS", key: str | None = None, prefix: Column | None = None) -> DataFrame:
    """(organism, ident, chrom, strand, exons, seqids_differ, strands_differ): one model per identifier.

    Equal lines count once; exons are sorted, not yet sanitised. Where lines disagree the smallest contig and the smallest
    strand but `.` are given, and the row is flagged. Exons are grouped in two steps, distinct ones first, so that lines
    delivered very often don't meet in one task."""
    rows = gff_identified(gff.where(F.col("gff_type") == feature), key, prefix)
    strand = F.when(F.col("gff_strand") != ".", F.col("gff_strand"))
    once = rows.groupBy("organism", "ident", F.trim("gff_seqid").alias("_c"), strand.alias("_s"), genes.exon(F.col("gff_start") - 1, F.col("gff_end")).alias("_e")).agg(F.lit(1).alias("_one"))
    return once.groupBy("organism", "ident").agg(
        F.min("_c").alias("chrom"),
        F.coalesce(F.min("_s"), F.lit(".")).alias("strand"),
        F.array_sort(F.collect_set("_e")).alias("exons"),
        (F.min("_c") != F.max("_c")).alias("_cd"),
        (F.min("_s") != F.max("_s")).alias("_sd"),
    ).select("organism", "ident", "chrom", "strand", "exons", F.coalesce("_cd", F.lit(False)).alias("seqids_differ"), F.coalesce("_sd", F.lit(False)).alias("strands_differ"))
