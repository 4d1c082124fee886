"""Counts over sequences: codons, splice-site motifs, k-mers.

Rows have `organism`, `strand`, `exons` and `seq`, the sequence that the exons lie on (BINARY or STRING). Counting is done
on the short strings themselves, combined before the shuffle; indices are made from the few counted rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exonia.functions.seq import NUCLEOTIDES, base4, codon_index, reverse_complement
from exonia.operators import genes
from exonia.session import evaluated

#: The default lengths (intronic motif, boundary behind it) of donor and acceptor sites.
DONOR_SIZE, ACCEPTOR_SIZE = (4, 2), (3, 15)
CLEAN = "^[ACGT]+$"
#: Windows of one block of a sequence.
WINDOW_BLOCK = 1 << 14


def triplets(s: Column) -> Column:
    """The full triplets of a sequence from its start."""
    return F.regexp_extract_all(s, F.lit("(.{3})"), F.lit(1))


def classed_codons(s: Column, cut_start: Column, cut_end: Column) -> Column:
    """(class, codon) of a sequence: `first` is the first unambiguous codon unless the start is cut off, all others are
    `middle`; `last` are the last three nucleotides, in whatever frame, unless the end is cut off. The last codon in frame
    therefore counts as middle too. A sequence of fewer than 3 has none."""
    one = lambda kind, codon: F.struct(kind.alias("class"), codon.alias("codon"))
    clean = F.filter(triplets(s), lambda c: c.rlike(CLEAN))
    inner = F.transform(clean, lambda c, i: one(F.when((i == 0) & ~cut_start, "first").otherwise("middle"), c))
    tail = F.filter(F.array(one(F.lit("last"), F.right(s, F.lit(3)))), lambda x: ~cut_end & (F.length(s) >= 3) & x["codon"].rlike(CLEAN))
    return F.concat(inner, tail)


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("organism", "class", "codon").agg(F.count("*").alias("n")).select("organism", "class", codon_index("codon").alias("codon_idx"), "n")


def codon_counts(models: DataFrame, seq: str = "seq") -> DataFrame:
    """(organism, class, codon_idx, n) over the coding sequences. An end of a gene at its sequence's end is cut off."""
    ex, st = F.col("exons"), F.col("strand")
    low = F.get(ex, 0)["start"] == 0
    high = F.element_at(ex, -1)["end"] == F.length(seq)
    reverse = genes.is_reverse(st)
    own = classed_codons(genes.cds(F.col(seq), ex, st), F.when(reverse, high).otherwise(low), F.when(reverse, low).otherwise(high))
    return _counted(models.where(F.size(ex) > 0).select("organism", F.inline(own)))


def null_codon_counts(models: DataFrame, seq: str = "seq") -> DataFrame:
    """As codon_counts, over the introns, each on both strands: what codons look like where nothing is coded."""
    both = F.flatten(F.transform(genes.intron_sequences(F.col(seq), F.col("exons"), F.col("strand")), lambda s: F.array(s, reverse_complement(s))))
    rows = models.select("organism", F.explode(both).alias("_s"))
    return _counted(rows.select("organism", F.inline(classed_codons(F.col("_s"), F.lit(False), F.lit(False)))))


def combined(counts: DataFrame) -> DataFrame:
    """Counts of the classes first, middle and last added up."""
    return counts.groupBy("organism", "codon_idx").agg(F.sum("n").alias("n"))


def nucleotide_marginals(counts: DataFrame) -> DataFrame:
    """(organism, nuc_idx, n): nucleotides of counted codons."""
    idx = F.col("codon_idx")
    three = F.array(F.shiftright(idx, 4), F.shiftright(idx, 2).bitwiseAND(3), idx.bitwiseAND(3))
    return counts.select("organism", F.explode(three).alias("nuc_idx"), "n").groupBy("organism", "nuc_idx").agg(F.sum("n").alias("n"))


def read_from(seq: Column, position: Column, length: int, forward: Column) -> Column:
    """length nucleotides from a position on, or the reverse complement of those up to it; null where they don't fit."""
    lo = F.when(forward, position).otherwise(position - length + 1)
    part = F.substring(seq, lo + 1, F.lit(length)).cast("string")
    return F.when((lo >= 0) & (lo + length <= F.length(seq)), F.when(forward, part).otherwise(reverse_complement(part)))


def site_texts(models: DataFrame, donor: bool, size: tuple[int, int] | None = None, seq: str = "seq") -> DataFrame:
    """(organism, motif, edge): per intron the motif at its donor or acceptor and the boundary behind it, read into the
    intron from the site; for acceptors that is on the other strand. Null where a part doesn't fit on the sequence."""
    m, b = size or (DONOR_SIZE if donor else ACCEPTOR_SIZE)
    forward = genes.is_reverse() != F.lit(donor)
    at = F.transform(genes.introns(F.col("exons"), F.col("strand")), lambda i: i["donor_pos" if donor else "acceptor_pos"])
    rows = models.select("organism", seq, forward.alias("_fw"), F.explode(at).alias("_at"))
    step = F.when(F.col("_fw"), m).otherwise(-m)
    edge = read_from(F.col(seq), F.col("_at") + step, b, F.col("_fw")) if b else F.lit("")
    return rows.select("organism", read_from(F.col(seq), F.col("_at"), m, F.col("_fw")).alias("motif"), edge.alias("edge"))


def motif_counts(texts: DataFrame) -> DataFrame:
    """(organism, motif_idx, n); -1 for ambiguous motifs and those that don't fit."""
    counted = texts.groupBy("organism", "motif").agg(F.count("*").alias("n"))
    return counted.groupBy("organism", F.coalesce(base4("motif"), F.lit(-1)).alias("motif_idx")).agg(F.sum("n").alias("n"))


def edge_counts(texts: DataFrame) -> DataFrame:
    """(organism, place, nuc_idx, n): the unambiguous nucleotides at each place of the boundary, from 0."""
    counted = texts.where(F.length("edge") > 0).groupBy("organism", "edge").agg(F.count("*").alias("n"))
    each = counted.select("organism", "n", F.posexplode(F.split("edge", "")).alias("place", "nuc"))
    known = each.where(F.col("nuc").isin(*NUCLEOTIDES))
    return known.groupBy("organism", "place", "nuc").agg(F.sum("n").alias("n")).select("organism", "place", (F.instr(F.lit(NUCLEOTIDES), F.col("nuc")) - 1).alias("nuc_idx"), "n")


def windows(rows: DataFrame, s: Column, k: int, dropped: int = 0) -> DataFrame:
    """rows with `_w`, a row for each window of length k of the sequence s but the last `dropped` ones; sequences that are
    too short and nulls give none. The sequence is made BINARY once, as a slice of that doesn't walk what is before it."""
    bytes_once = evaluated(rows, _b=F.to_binary(s, F.lit("utf-8")))
    count = F.length("_b") - k + 1 - dropped
    # Blocks overlap by k - 1, so that each window lies in one of them; the windows of a block are put in one array.
    size = lambda b: F.least(F.lit(WINDOW_BLOCK), count - b * WINDOW_BLOCK) + k - 1
    blocks = F.transform(F.sequence(F.lit(0), ((count - 1) / WINDOW_BLOCK).cast("int")), lambda b: F.substring("_b", b * WINDOW_BLOCK + 1, size(b)))
    cut = bytes_once.where(count > 0).select(*rows.columns, F.explode(blocks).alias("_block"))
    each = F.transform(F.sequence(F.lit(1), F.length("_block") - k + 1), lambda i: F.substring("_block", i, F.lit(k)))
    return cut.select(*rows.columns, F.explode(each).alias("_w")).withColumn("_w", F.col("_w").cast("string"))


def _null_texts(models: DataFrame, donor: bool, seq: str) -> DataFrame:
    """(organism, _s): coding sequences, for acceptors their reverse complements."""
    coding = genes.cds(F.col(seq), F.col("exons"), F.col("strand"))
    return evaluated(models.select("organism", seq, "exons", "strand"), _s=coding if donor else reverse_complement(coding)).select("organism", "_s")


def null_motif_counts(models: DataFrame, donor: bool, size: tuple[int, int] | None = None, seq: str = "seq") -> DataFrame:
    """As motif_counts, over all windows of motif and boundary but the last of the coding sequences (of their reverse
    complements for acceptors): what sites look like where there are none."""
    m, b = size or (DONOR_SIZE if donor else ACCEPTOR_SIZE)
    each = windows(_null_texts(models, donor, seq), F.col("_s"), m, b + 1)
    return motif_counts(each.select("organism", F.col("_w").alias("motif")))


def null_edge_counts(models: DataFrame, donor: bool, size: tuple[int, int] | None = None, seq: str = "seq") -> DataFrame:
    """As edge_counts, over the same windows. What all windows have at one place is one slice of the sequence, whose
    nucleotides are counted at once."""
    m, b = size or (DONOR_SIZE if donor else ACCEPTOR_SIZE)
    rows = evaluated(_null_texts(models, donor, seq), _b=F.to_binary("_s", F.lit("utf-8")))
    n = F.length("_b") - m - b
    for place in range(b):
        rows = evaluated(rows, **{f"_p{place}": F.substring("_b", F.lit(m + place + 1), n).cast("string")})
    each = [
        F.struct(F.lit(place).alias("place"), F.lit(k).alias("nuc_idx"), (F.length(f"_p{place}") - F.length(F.replace(f"_p{place}", F.lit(nuc), F.lit("")))).alias("n"))
        for place in range(b)
        for k, nuc in enumerate(NUCLEOTIDES)
    ]
    return rows.where(n > 0).select("organism", F.inline(F.array(*each))).where("n > 0").groupBy("organism", "place", "nuc_idx").agg(F.sum("n").alias("n"))


def kmer_counts(rows: DataFrame, seq: str, k: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys..., kmer_idx, reverse_idx, n) of all unambiguous windows of length k (1 to 31), with the index of the reverse
    complement; shorter sequences and nulls give none."""
    if not 1 <= k <= 31:
        raise ValueError("k is 1 to 31")
    each = windows(rows.select(*keys, F.col(seq).cast("string").alias("_s")), F.col("_s"), k)
    counted = each.groupBy(*keys, "_w").agg(F.count("*").alias("n")).where(F.col("_w").rlike(CLEAN))
    long = lambda s: F.conv(F.translate(s, NUCLEOTIDES, "0123"), 4, 10).cast("bigint")
    return counted.select(*keys, long(F.col("_w")).alias("kmer_idx"), long(reverse_complement(F.col("_w"))).alias("reverse_idx"), "n")


def base_counts(seq: Column | str) -> dict[str, Column]:
    """A column for each of A, C, G, T and N: how often it occurs."""
    s = F.col(seq) if isinstance(seq, str) else seq
    return {f"n_{b.lower()}": F.length(s) - F.length(F.replace(s, F.lit(b), F.lit(""))) for b in "ACGTN"}


def sequence_blocks(contigs: DataFrame, seq: str = "seq", size: int = 1 << 16) -> DataFrame:
    """(organism, chrom, block, bytes): sequences cut into blocks, so that a long or hot contig is spread over tasks."""
    n = F.ceil(F.length(seq) / size).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.struct(b.alias("block"), F.substring(F.col(seq), b * size + 1, F.lit(size)).cast("binary").alias("bytes")))
    return contigs.where(F.length(seq) > 0).select("organism", "chrom", F.inline(cut))


def slices(ranges: DataFrame, blocks: DataFrame, keep: list[str], start: str = "start", end: str = "end", size: int = 1 << 16) -> DataFrame:
    """(keep..., organism, chrom, start, end, text): the sequence of each range [start, end) (start < end), read block by
    block: ranges meet blocks on (organism, chrom, block). Parts off the contig are missing from text; a range on no
    known contig has no row. keep, organism, chrom, start and end together name a range; equal ones come out once."""
    at = ranges.select(*keep, "organism", "chrom", start, end).where(F.col(start) < F.col(end)).withColumn("block", F.explode(F.sequence(F.expr(f"greatest({start}, 0) div {size}"), F.expr(f"greatest({end} - 1, 0) div {size}"))))
    lo = F.greatest(F.col(start) - F.col("block") * size, F.lit(0)).cast("int")
    hi = F.least(F.col(end) - F.col("block") * size, F.lit(size)).cast("int")
    part = at.join(blocks, ["organism", "chrom", "block"]).select(*keep, "organism", "chrom", start, end, "block", F.substring("bytes", lo + 1, hi - lo).cast("string").alias("_part"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("block", "_part"))), lambda x: x["_part"]), "")
    return part.groupBy(*keep, "organism", "chrom", start, end).agg(whole.alias("text"))
