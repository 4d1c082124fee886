"""Gene models on hand-made cases, and edits that undo each other."""

import random

import pytest
from exonia.functions import seq as S
from exonia.operators import counting, genes
from exonia.sources import text_lines
from pyspark.sql import functions as F

EX = "array<struct<start:int,end:int>>"


def model(spark, exons, strand="+", seq=None):
    return spark.createDataFrame([("aa", "chr1", "g", strand, exons, seq)], f"organism string, chrom string, accno string, strand string, exons {EX}, seq string")


def value(df, column):
    return df.select(column.alias("v")).first().v


def pairs(v):
    return None if v is None else [tuple(x) for x in v]


@pytest.mark.parametrize(("exons", "problem", "fused"), [
    ([(0, 5), (5, 9)], None, [(0, 9)]), ([(0, 5), (5, 9), (9, 12), (20, 30)], None, [(0, 12), (20, 30)]), ([(5, 4)], "negative", [(5, 4)]),
    ([(0, 5), (4, 9)], "overlap", [(0, 5), (4, 9)]), ([(0, 5), (7, 9)], "short", [(0, 5), (7, 9)]), ([(0, 5), (8, 9)], None, [(0, 5), (8, 9)]), ([], None, []),
])
def test_sanitising(spark, exons, problem, fused):
    got = genes.sanitised(model(spark, exons)).first()
    assert (got.problem, pairs(got.exons)) == (problem, fused)


def test_introns_and_phases_on_both_strands(spark):
    exons = [(4, 10), (20, 26), (31, 33)]
    up, down = model(spark, exons), model(spark, exons, "-")
    ex, st = F.col("exons"), F.col("strand")
    assert [tuple(i) for i in value(up, genes.introns(ex, st))] == [(0, 10, 19, 10, 6, 0), (1, 26, 30, 5, 12, 0)]
    assert [tuple(i) for i in value(down, genes.introns(ex, st))] == [(0, 30, 26, 5, 2, 2), (1, 19, 10, 10, 8, 2)]
    assert value(up, genes.exon_phases(ex, st)) == [0, 0, 0] and value(down, genes.exon_phases(ex, st)) == [1, 1, 0]
    assert value(model(spark, [(1, 5)]), genes.introns(ex, st)) == []
    assert [value(up, genes.position_of_offset(ex, st, F.lit(k))) for k in (0, 6, 13, 14)] == [4, 20, 32, None]
    assert [value(down, genes.position_of_offset(ex, st, F.lit(k))) for k in (0, 2, 13)] == [32, 25, 4]
    assert [value(up, genes.containing_exon(ex, F.lit(k))) for k in (4, 10, 25, 99)] == [0, None, 1, None]


def test_annotation_line_of_the_micro_fixture(spark):
    m = model(spark, [(4, 10), (20, 26)])
    assert value(m, text_lines.annotation_line(F.lit("aa|g1"))) == "chr1\taa|g1\taa|g1\tfull\t+\t4\t6\t10\taa|g1\taa\t5\t4,20\t10,26"
    assert value(model(spark, [(0, 4)]), text_lines.annotation_line(F.lit("g"))).split("\t")[5:8] == ["1.3333333333333333", "00", "00"]
    assert value(m, text_lines.gff3_lines(F.lit("g"), "x"))[1] == "chr1\tx\tCDS\t21\t26\t.\t+\t0\tID=g"


def test_edits_undo_each_other(spark):
    r = random.Random(2)
    ex, st = F.col("exons"), F.col("strand")
    data = []
    for _ in range(60):
        at, exons = r.randint(0, 50), []
        for _ in range(r.randint(1, 5)):
            exons.append((at, at := at + r.randint(60, 200)))
            at += r.randint(30, 90)
        s, e = r.choice(exons)
        lo, hi = s + r.randint(1, 15), e - r.randint(2, 15)
        strand = r.choice("+-.")
        data.append((exons, strand, *((hi, lo) if strand == "-" else (lo, hi))))
    df = spark.createDataFrame(data, f"exons {EX}, strand string, d int, a int")
    with_new = df.withColumn("new", genes.intronify(ex, st, F.col("d"), F.col("a")))
    for x in with_new.select("exons", "new", genes.exonify(F.col("new"), st, F.col("d"), F.col("a")).alias("back")).collect():
        assert len(x.new) == len(x.exons) + 1 and x.back == x.exons
    moved = with_new.withColumn("to", genes.shift_site(genes.shift_site(F.col("new"), st, F.col("d") + F.when(st == "-", -2).otherwise(2), True), st, F.col("d"), True))
    assert moved.where("to <> new").count() == 0
    assert value(model(spark, [(0, 9), (20, 30)]), genes.exonify(ex, st, F.lit(8), F.lit(19))) is None


def test_strand_symmetry(spark):
    """Turning a contig around and mirroring its genes leaves all statistics as they are."""
    r = random.Random(4)
    seq = "".join(r.choice("ACGT") for _ in range(900)) + "N" * 5
    exons = [(30, 120), (180, 300), (390, 600), (640, 905)]
    n = len(seq)
    turned = seq.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    a = model(spark, exons, "+", seq)
    b = model(spark, [(n - e, n - s) for s, e in exons[::-1]], "-", turned)
    for f in (counting.codon_counts, counting.null_codon_counts, lambda m: counting.motif_counts(counting.site_texts(m, True)), lambda m: counting.edge_counts(counting.site_texts(m, False)), lambda m: counting.null_motif_counts(m, False), lambda m: counting.null_edge_counts(m, False), lambda m: counting.null_edge_counts(m, True), genes.length_histograms, genes.phase_transitions):
        assert sorted(map(tuple, f(a).collect())) == sorted(map(tuple, f(b).collect()))


def test_codon_classes(spark):
    got = counting.codon_counts(model(spark, [(1, 10)], "+", "CATGAAATAAC"))
    assert sorted((x["class"], x.codon_idx) for x in got.collect()) == [("first", 14 - 1), ("last", 48), ("middle", 0), ("middle", 48)]
    # A gene cut off at the contig's start has no first codon.
    cut = counting.codon_counts(model(spark, [(0, 9)], "+", "ATGAAATAAC"))
    assert {x["class"] for x in cut.collect()} == {"middle", "last"}


def test_sequence_functions(spark):
    one = spark.range(1)
    lit = F.lit
    assert value(one, S.reverse_complement(lit("AWATC"))) == "GATWT"
    assert [value(one, S.codon_index(lit(c))) for c in ("AAA", "AAG", "GGG", "TTT", "ANA", "AA", "")] == [0, 1, 21, 63, None, None, None]
    assert [value(one, S.base4(lit(c))) for c in ("GT", "AG", "CT", "N")] == [7, 1, 11, None]
    assert [value(one, S.from_base4(lit(i), 3)) for i in (0, 1, 21, 63)] == ["AAA", "AAG", "GGG", "TTT"]
    assert value(one, S.dna(lit("acgxu-r"))) == "ACGNTNR"
    assert value(one, S.dna_slice(lit("AACCGT"), lit(2), lit(5))) == "CCG" and value(one, S.dna_slice(lit("AACCGT"), lit(5), lit(2))) == "CGG"
    assert value(one, S.residue_of(lit(48))) == "*" and value(one, S.is_stop(lit(0))) is False
    assert [value(one, S.residue(lit(c))) for c in ("A", "-", ".", "a", "J", "AB")] == ["A", "-", ".", None, None, None]
    assert value(one, S.from_column_code(S.column_code(F.array(lit(0), lit(None).cast("int"), lit(63))))) == [0, None, 63]
    assert value(one, S.alignment_name(lit("/a/b.c/og12.x.fa"))) == "og12"
    assert value(one, S.tag(lit("x /organism='a b' /organism=c"), "organism")) == "a b"
    assert value(one, S.tag(lit("x"), "organism")) is None
    assert value(one, S.codon_distance(lit(0), lit(21))) == 3
    assert value(one, S.codon_text(lit(None).cast("int"))) == "---/-" and value(one, S.codon_text(lit(0))) == "AAA/K"
    assert [value(one, S.is_purine(lit(c))) for c in "AC"] == [True, False]
    assert value(one, S.cell_text(lit(7), lit(0), lit(2))) == "7:AAA/K^2"


def test_protein_gene_join_with_fallback(spark):
    g = spark.createDataFrame([("b", "x", 1), ("a", "x", 2), ("a", "y", 3), (None, "z", 4)], "organism string, accno string, n int")
    p = spark.createDataFrame([(1, "b", "x"), (2, None, "x"), (3, "c", "x"), (4, None, None), (5, None, "z")], "i int, organism string, seq_id string")
    got = {r.i: r.gene_row and r.gene_row.n for r in genes.with_gene(p, g).collect()}
    assert got == {1: 1, 2: 2, 3: None, 4: None, 5: None}


def test_last_wins(spark):
    df = spark.createDataFrame([("a", "x", 1, "old"), ("a", "x", 2, "new"), (None, "x", 1, "n"), ("a", None, 5, "gone"), ("a", "x", 2, "new")], "o string, k string, t int, v string")
    assert sorted(r.v for r in genes.last_wins(df, ["o", "k"], ["t", "v"]).collect()) == ["n", "new"]


def test_dense_counts(spark):
    h = spark.createDataFrame([("a", 2, 5), ("a", 4, 1), ("b", 0, 3)], "o string, value int, n int")
    assert sorted(map(tuple, genes.dense_counts(h, ["o"]).collect())) == [("a", 0, 0), ("a", 1, 0), ("a", 2, 5), ("a", 3, 0), ("a", 4, 1), ("b", 0, 3)]


def test_slices_across_blocks(spark):
    r = random.Random(1)
    seq = "".join(r.choice("ACGT") for _ in range(200))
    contig = spark.createDataFrame([("o", "c", bytearray(seq.encode()))], "organism string, chrom string, seq binary")
    ranges = spark.createDataFrame([(i, "o", "c", s, s + n) for i, (s, n) in enumerate([(0, 5), (10, 100), (63, 2), (190, 40), (5, 0)])], "i int, organism string, chrom string, start int, end int")
    got = {x.i: x.text for x in counting.slices(ranges, counting.sequence_blocks(contig, size=16), ["i"], size=16).collect()}
    assert got == {0: seq[:5], 1: seq[10:110], 2: seq[63:65], 3: seq[190:]}


def test_gff_lines_to_models(spark):
    lines = ["##gff", "chr1\tx\tCDS\t21\t26\t.\t+\t0\tID=cds:g1;Parent=t1", "chr1\tx\tCDS\t5\t10\t.\t.\t0\tID=cds:g1;Parent=t1", "chr1\tx\tmRNA\t5\t26\t.\t+\t.\tID=t1", "chr1\tx\tCDS\t1\t2\t.\t+\t.\tParent=t1", "chr1\tx\tCDS\t21\t26\t.\t-\t0\tID=g2", "chr2\tx\tCDS\t31\t36\t.\t+\t0\tID=g2"]
    gff = text_lines.read_gff(spark.createDataFrame([(x,) for x in lines], "value string"), "aa").withColumn("dialect", F.lit("gff3"))
    got = {m.ident: m for m in text_lines.gff_models(gff).collect()}
    assert pairs(got["aa|g1"].exons) == [(4, 10), (20, 26)] and got["aa|g1"].strand == "+"
    assert got["aa|g2"].strands_differ and got["aa|g2"].seqids_differ and len(got) == 2


def test_annotation_tables(spark):
    lines = ["#head", "c\tg\tg1\tfull\t+\t2\t00\t00\tg\taa\t5\t4,20,\t10,26,", "c\tg\tg2\tfull\t+\t2\t00\t00\tg\tzz\t5\t4\t10", "c\tg\tg3\tfull\t+\t2\t00\t00\tg\taa\t5\t4,20\t10", "short"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = {x.gene: (x.problem, pairs(x.exons)) for x in text_lines.read_table(df, organisms=spark.createDataFrame([("aa",)], "organism string")).collect()}
    assert got == {"g1": (None, [(4, 10), (20, 26)]), "g3": ("unreadable", None)}
    ucsc = spark.createDataFrame([("n\tc\t-\t0\t9\t0\t9\t1\t0,\t9,",)], "value string")
    assert text_lines.read_table(ucsc, "genepred", "o").first().gene == "n"
