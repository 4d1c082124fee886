"""Gene models: normalising, coordinates in transcription order, and edits.

A gene model is a row with `strand` and `exons`, an array of (start, end) in ascending order, 0-based and end-exclusive.
Everything that concerns one model is an expression over its row, so that no exon is shuffled to be put in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exonia.functions.seq import REVERSE, dna_slice, reverse_complement, splice_sites
from exonia.session import digits, evaluated, join_null_safe

EXONS = "array<struct<start:int,end:int>>"
#: An intron below this length is reported as very short.
SHORT_INTRON = 3


def exon(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def zipped(starts: Column, ends: Column) -> Column:
    """Exons of two lists of equal length, in the lists' order; null where the lengths differ or a value is no int."""
    pairs = F.zip_with(starts, ends, lambda s, e: exon(s.try_cast("int"), e.try_cast("int")))
    whole = F.forall(pairs, lambda p: p["start"].isNotNull() & p["end"].isNotNull())
    return F.when((F.size(starts) == F.size(ends)) & (F.size(starts) > 0) & whole, pairs)


def sorted_exons(exons: Column) -> Column:
    return F.array_sort(exons)


def previous(exons: Column, test) -> Column:
    """Whether test(exon before, exon) holds anywhere."""
    inner = F.slice(exons, 2, F.greatest(F.size(exons) - 1, F.lit(0)))
    return F.exists(F.zip_with(F.slice(exons, 1, F.size(inner)), inner, test), lambda x: x)


def exon_problem(exons: Column) -> Column:
    """`negative` (an exon ends before it starts), `overlap` (an exon starts before the one before ends), `short` (an intron
    of 1 or 2), or null; the first that holds. Touching exons are no problem: they are fused."""
    gap = lambda a, b: b["start"] - a["end"]
    return (
        F.when(F.exists(exons, lambda e: e["start"] > e["end"]), "negative")
        .when(previous(exons, lambda a, b: gap(a, b) < 0), "overlap")
        .when(previous(exons, lambda a, b: (gap(a, b) > 0) & (gap(a, b) < SHORT_INTRON)), "short")
    )


def fused(exons: Column) -> Column:
    """The exons with those that touch made one."""

    def add(done: Column, e: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        before = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        joined = F.concat(before, F.array(exon(last["start"], e["end"])))
        return F.when(last["end"] == e["start"], joined).otherwise(F.concat(done, F.array(exon(e["start"], e["end"]))))

    return F.aggregate(exons, F.expr(f"cast(array() as {EXONS})"), add)


def sanitised(models: DataFrame, exons: str = "exons") -> DataFrame:
    """models with `problem` and their exons fused. Models without exons have problem null and stay as they are."""
    return evaluated(models, **{"problem": exon_problem(F.col(exons)), exons: fused(F.col(exons))})


def last_wins(models: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of models with equal keys the last one; a null in the last key drops the row. Ties in `order` are broken by all
    of the columns named there, so name a unique one last. Salted by the order's hash before the last step."""
    named = models.where(F.col(keys[-1]).isNotNull())
    row = F.struct(*order, F.struct(*models.columns).alias("_row"))
    salt = F.pmod(F.xxhash64(*order), F.lit(16))
    once = named.groupBy(*keys, salt.alias("_salt")).agg(F.max(row).alias("_best"))
    return once.groupBy(*keys).agg(F.max("_best").alias("_best")).select("_best._row.*")


def is_reverse(strand: Column | str = "strand") -> Column:
    return (F.col(strand) if isinstance(strand, str) else strand) == REVERSE


def length_before(exons: Column, strand: Column) -> Column:
    """For each exon (in ascending order) the coding length before it in transcription order."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda n, e: n + e["end"] - e["start"])
    return F.transform(exons, lambda e, i: F.when(strand == REVERSE, total(F.slice(exons, i + 2, F.size(exons)))).otherwise(total(F.slice(exons, F.lit(1), i))))


def coding_length(exons: Column) -> Column:
    return F.aggregate(exons, F.lit(0), lambda n, e: n + e["end"] - e["start"])


def exon_phases(exons: Column, strand: Column) -> Column:
    """Of each exon the nucleotides to skip until the next codon begins."""
    return F.transform(length_before(exons, strand), lambda n: (3 - n % 3) % 3)


def introns(exons: Column, strand: Column) -> Column:
    """(iidx, donor_pos, acceptor_pos, length, cds_offset, phase) of the introns in transcription order. phase is the offset
    modulo 3; the codon walk's phase 3 is 0 here."""
    n, reverse = F.size(exons), strand == REVERSE
    part = lambda a, first: F.slice(a, first, F.greatest(n - 1, F.lit(0)))
    sides = F.zip_with(part(exons, F.lit(1)), part(exons, F.lit(2)), lambda x, y: F.struct(x["end"].alias("lo"), y["start"].alias("hi")))
    offsets = part(length_before(exons, strand), F.when(reverse, 1).otherwise(2))
    ascending = F.zip_with(sides, offsets, lambda x, o: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), o.alias("offset")))

    def one(x: Column, k: Column) -> Column:
        donor, acceptor = splice_sites(strand, x["lo"], x["hi"])
        return F.struct(k.alias("iidx"), donor.alias("donor_pos"), acceptor.alias("acceptor_pos"), (x["hi"] - x["lo"]).alias("length"), x["offset"].alias("cds_offset"), (x["offset"] % 3).alias("phase"))

    return F.transform(F.when(reverse, F.reverse(ascending)).otherwise(ascending), one)


def clipped(exons: Column, start: Column, end: Column) -> Column:
    """What of the exons lies within [start, end)."""
    part = F.transform(exons, lambda e: exon(F.greatest(e["start"], start), F.least(e["end"], end)))
    return F.filter(part, lambda e: e["start"] < e["end"])


def containing_exon(exons: Column, position: Column) -> Column:
    """The index of the exon that holds a position; null for none."""
    at = F.array_position(F.transform(exons, lambda e: (e["start"] <= position) & (position < e["end"])), True)
    return F.when(at > 0, (at - 1).cast("int"))


def position_of_offset(exons: Column, strand: Column, offset: Column) -> Column:
    """The genomic position of a coding offset; null beyond the end."""
    before = length_before(exons, strand)
    hits = F.filter(
        F.zip_with(exons, before, lambda e, n: F.struct(e["start"].alias("start"), e["end"].alias("end"), n.alias("before"))),
        lambda x: (x["before"] <= offset) & (offset < x["before"] + x["end"] - x["start"]),
    )
    hit = F.get(hits, 0)
    return F.when(strand == REVERSE, hit["end"] - 1 - (offset - hit["before"])).otherwise(hit["start"] + offset - hit["before"])


def offset_of_position(exons: Column, strand: Column, position: Column) -> Column:
    """The coding offset of a genomic position; null outside the exons."""
    within = lambda e: F.when(strand == REVERSE, e["end"] - 1 - position).otherwise(position - e["start"])
    return F.array_max(F.zip_with(exons, length_before(exons, strand), lambda e, n: F.when((e["start"] <= position) & (position < e["end"]), n + within(e))))


def codon_at(coding: Column, exons: Column, strand: Column, position: Column) -> Column:
    """The three coding bases from a genomic position on, in transcription order and across introns; null outside the exons, for
    ambiguous bases and where the coding sequence ends before the third."""
    codon = F.substring(coding, offset_of_position(exons, strand, position) + 1, F.lit(3))
    return F.when(codon.rlike("^[ACGT]{3}$"), codon)


def cds(seq: Column, exons: Column, strand: Column) -> Column:
    """The coding sequence of exons on the same row's sequence, in transcription order."""
    whole = F.array_join(F.transform(exons, lambda e: F.substring(seq, e["start"] + 1, e["end"] - e["start"]).cast("string")), "")
    return F.when(strand == REVERSE, reverse_complement(whole)).otherwise(whole)


def intron_sequences(seq: Column, exons: Column, strand: Column) -> Column:
    """The introns' sequences in transcription orientation, in ascending order of position."""
    inner = F.slice(exons, 2, F.greatest(F.size(exons) - 1, F.lit(0)))
    return F.zip_with(F.slice(exons, 1, F.size(inner)), inner, lambda a, b: F.when(strand == REVERSE, dna_slice(seq, b["start"], a["end"])).otherwise(dna_slice(seq, a["end"], b["start"])))


def shift_site(exons: Column, strand: Column, position: Column, donor: bool) -> Column:
    """The donor (or acceptor) next to a position moved to it. On the side where an exon begins this is the first exon that
    ends after the position, where one ends the last exon that starts at or before it."""
    begins = is_reverse(strand) if donor else ~is_reverse(strand)
    first = F.size(F.filter(exons, lambda e: e["end"] <= position))
    last = F.size(F.filter(exons, lambda e: e["start"] <= position)) - 1
    return F.when(begins, F.transform(exons, lambda e, i: exon(F.when(i == first, position + 1).otherwise(e["start"]), e["end"]))).otherwise(
        F.transform(exons, lambda e, i: exon(e["start"], F.when(i == last, position).otherwise(e["end"])))
    )


def _bounds(strand: Column, donor: Column, acceptor: Column) -> tuple[Column, Column]:
    """(end of the exon below, start of the exon above) an intron."""
    return F.when(is_reverse(strand), acceptor).otherwise(donor), F.when(is_reverse(strand), donor).otherwise(acceptor) + 1


def exonify(exons: Column, strand: Column, donor: Column, acceptor: Column) -> Column:
    """The model without the intron between a donor and an acceptor; null where these aren't its exact bounds."""
    below, above = _bounds(strand, donor, acceptor)
    left = F.filter(exons, lambda e: e["end"] == below)
    right = F.filter(exons, lambda e: e["start"] == above)
    joined = F.concat(
        F.filter(exons, lambda e: e["end"] < below),
        F.array(exon(F.get(left, 0)["start"], F.get(right, 0)["end"])),
        F.filter(exons, lambda e: e["start"] > above),
    )
    return F.when((F.size(left) == 1) & (F.size(right) == 1) & (below < above), joined)


def intronify(exons: Column, strand: Column, donor: Column, acceptor: Column) -> Column:
    """The model with a new intron; null where its ends don't lie in exons."""
    below, above = _bounds(strand, donor, acceptor)
    left = F.filter(exons, lambda e: (e["start"] <= below) & (below <= e["end"]))
    right = F.filter(exons, lambda e: (e["start"] <= above) & (above <= e["end"]))
    split = F.concat(
        F.filter(exons, lambda e: e["end"] < below),
        F.array(exon(F.get(left, 0)["start"], below), exon(above, F.get(right, 0)["end"])),
        F.filter(exons, lambda e: e["start"] > above),
    )
    return F.when((F.size(left) > 0) & (F.size(right) > 0) & (below < above), split)


def normal_ident(ident: Column, prefix: Column | None = None) -> Column:
    """A gene's identifier without the quotes around it and what stands before a colon, with a prefix put before it."""
    bare = F.when(F.startswith(ident, F.lit('"')), F.regexp_extract(ident, '^"(.*)"', 1)).otherwise(ident)
    cut = F.regexp_replace(bare, "^[^:]*:", "")
    return cut if prefix is None else F.concat(prefix, cut)


def place_text(chrom: Column, strand: Column, exons: Column) -> Column:
    return F.format_string("%s%s:%d..%d", chrom, strand, F.get(exons, 0)["start"], F.element_at(exons, -1)["end"])


def short_text(name: Column, chrom: Column, strand: Column, exons: Column, with_exons: bool = False) -> Column:
    """A one-line description of a model."""
    text = F.concat(F.lit("GP['"), name, F.lit("' @ "), place_text(chrom, strand, exons), F.lit(" exons["), F.size(exons).cast("string"), F.lit("]"))
    if with_exons:
        text = F.concat(text, F.lit("={"), F.array_join(F.transform(exons, lambda e: F.format_string("%d..%d", e["start"], e["end"])), ","), F.lit("}"))
    return F.concat(text, F.lit("]"))


def with_gene(proteins: DataFrame, genes: DataFrame, organism: str = "organism", name: str = "seq_id", accno: str = "accno") -> DataFrame:
    """Each protein with its gene as `gene_row`, a struct of genes' columns: by (organism, name), and where its organism is
    null by name alone, of several the one with the smallest organism. Proteins without a gene come out with null.

    genes must have one row an (organism, accno); see last_wins. A null name has no gene."""
    row = F.struct(*genes.columns)
    known = genes.where(F.col("organism").isNotNull() & F.col(accno).isNotNull())
    own = known.select(F.col("organism").alias("_org"), F.col(accno).alias("_name"), row.alias("gene_row"))
    any_org = own.groupBy("_name").agg(F.min_by("gene_row", "_org").alias("gene_row")).withColumn("_org", F.lit(None).cast("string"))
    keyed = proteins.withColumns({"_org": F.col(organism), "_name": F.col(name)})
    # Those without a name can match nothing, and would all meet at one key.
    named, others = keyed.where(F.col("_name").isNotNull()), keyed.where(F.col("_name").isNull())
    found = join_null_safe(named, own.unionByName(any_org), ["_org", "_name"], "left")
    kind = own.schema["gene_row"].dataType
    return found.select(*proteins.columns, "gene_row").unionByName(others.select(*proteins.columns, F.lit(None).cast(kind).alias("gene_row")))


def models_of(genepred: DataFrame, starts: str = "exonstarts", ends: str = "exonends") -> DataFrame:
    """The table's rows with `exons` in ascending order instead of the two lists, rows with null or unequal lists left out."""
    lists = evaluated(genepred, _s=digits(starts), _e=digits(ends)).where(F.size("_s") == F.size("_e"))
    return evaluated(lists, exons=sorted_exons(zipped(F.col("_s"), F.col("_e")))).where(F.col("exons").isNotNull()).drop(starts, ends, "_s", "_e")


def length_histograms(models: DataFrame) -> DataFrame:
    """(organism, kind, value, n): how many models have so many exons, how many exons and introns are so long."""
    own = introns(F.col("exons"), F.col("strand"))
    values = F.concat(
        F.array(F.struct(F.lit("exon_count").alias("kind"), F.size("exons").alias("value"))),
        F.transform("exons", lambda e: F.struct(F.lit("exon_length").alias("kind"), (e["end"] - e["start"]).alias("value"))),
        F.transform(own, lambda i: F.struct(F.lit("intron_length").alias("kind"), i["length"].alias("value"))),
    )
    return models.select("organism", F.inline(values)).groupBy("organism", "kind", "value").agg(F.count("*").alias("n"))


def phase_transitions(models: DataFrame) -> DataFrame:
    """(organism, before, phase, n): the phases of consecutive introns; before is -1 at a gene's first."""
    own = F.transform(introns(F.col("exons"), F.col("strand")), lambda i: i["phase"])
    pairs = F.zip_with(F.concat(F.array(F.lit(-1)), F.slice(own, F.lit(1), F.greatest(F.size(own) - 1, F.lit(0)))), own, lambda a, b: F.struct(a.alias("before"), b.alias("phase")))
    return models.select("organism", F.inline(F.filter(pairs, lambda p: p["phase"].isNotNull()))).groupBy("organism", "before", "phase").agg(F.count("*").alias("n"))


def length_statistics(histogram: DataFrame, group: list[str], value: str = "value", n: str = "n") -> DataFrame:
    """Mean, mode (the smallest of equals), variance and standard deviation of a histogram, per group."""
    v, k = F.col(value).cast("double"), F.col(n)
    sums = histogram.groupBy(*group).agg(F.sum(k).alias("total"), F.sum(v * k).alias("_s"), F.sum(v * v * k).alias("_q"), F.max_by(value, F.struct(k, -F.col(value))).alias("mode"))
    mean = F.col("_s") / F.col("total")
    var = F.col("_q") / F.col("total") - mean * mean
    return sums.select(*group, "total", mean.alias("mean"), "mode", var.alias("variance"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("sd"))


def dense_counts(histogram: DataFrame, group: list[str], value: str = "value", n: str = "n") -> DataFrame:
    """The histogram with a row of 0 for each value from 0 to the group's largest that it lacks."""
    after = F.lead(value).over(Window.partitionBy(*group).orderBy(value))
    first = F.lag(value).over(Window.partitionBy(*group).orderBy(value)).isNull()
    # Each row fills the gap behind it; the first also the one before.
    gap = histogram.withColumns({"_to": F.coalesce(after - 1, F.col(value)), "_from": F.when(first, F.least(F.lit(0), F.col(value))).otherwise(F.col(value))})
    filled = gap.withColumn("_v", F.explode(F.sequence("_from", "_to")))
    return filled.select(*group, F.col("_v").alias(value), F.when(F.col("_v") == F.col(value), F.col(n)).otherwise(0).alias(n))
