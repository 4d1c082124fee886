"""Text reports: reconstructions, edits, gap counts, statistics, as columns or tables of lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exonia.functions.seq import NUCLEOTIDES, cell_text, codon_text, from_base4, reverse_complement
from exonia.operators import alignment, genes, scoring
from exonia.session import evaluated
from exonia.sources.newick import quoted


def placement(donor: Column, acceptor: Column, phase: Column, state: Column) -> Column:
    return F.when(state == "intron", F.format_string("%d..%d/%d", donor, acceptor, phase)).otherwise(state)


def ancestral_header(tree: list[tuple[str, str | None]]) -> str:
    return "\t".join(["#ANCESTRAL", *(quoted(name) for name, _ in tree)])


def ancestral_lines(nodes: DataFrame, tree: list[tuple[str, str | None]]) -> DataFrame:
    """(alignment, ctx, value): a line for each context: in the tree's post-order every node's [phase:]event, then the number of leaves with the intron,
    the alignment and the context."""
    order = F.create_map(*(F.lit(x) for k, (name, _) in enumerate(tree) for x in (name, k)))
    cell = F.concat(F.when(F.col("state") == "intron", F.concat(F.col("phase").cast("string"), F.lit(":"))).otherwise(""), F.col("event"))
    rows = nodes.groupBy("alignment", "ctx").agg(
        F.array_sort(F.collect_list(F.struct(order[F.col("node")].alias("k"), cell.alias("cell")))).alias("cells"),
        F.count_if(F.col("is_leaf") & (F.col("state") == "intron")).alias("leaves"),
    )
    return rows.select("alignment", "ctx", F.concat_ws("\t", F.lit("#ANCESTRAL"), F.transform("cells", lambda x: x["cell"]), F.col("leaves").cast("string"), "alignment", F.concat(F.lit("C"), F.col("ctx").cast("string"))).alias("value"))


def history_lines(nodes: DataFrame) -> DataFrame:
    """(alignment, ctx, node_no, value): a line for each node, in the tree's post-order: its placement (a leaf's in its organism's
    coordinates), event, its parent's placement (== where it is the same) and its parent; for a leaf with an intron the shifts
    of its sites from the annotated ones (new: none is annotated) and its dinucleotides; then alignment and context."""
    own = placement(F.col("donor"), F.col("acceptor"), F.col("phase"), F.col("state"))
    shown = F.when(F.col("own_donor").isNotNull(), placement(F.col("own_donor"), F.col("own_acceptor"), F.col("phase"), F.col("state"))).otherwise(own)
    above = nodes.select("alignment", "ctx", F.col("node").alias("parent"), own.alias("_above"))
    joined = nodes.withColumn("_own", own).join(above, ["alignment", "ctx", "parent"], "left")
    before = F.when(F.coalesce("_above", F.col("_own")) == F.col("_own"), "==").otherwise(F.col("_above"))
    kind = F.when(F.col("is_leaf"), "leaf ").otherwise("node ")
    shift = F.when(F.col("donor_shift").isNotNull(), F.format_string("%+d,%+d", "donor_shift", "acceptor_shift")).when(F.col("own_donor").isNotNull(), "new")
    cells = [F.concat(F.lit("#HISTORY "), kind, F.col("node")), shown, F.col("event"), before, F.col("parent"), shift, F.concat(F.lit("ss:"), F.col("motifs")), F.col("alignment"), F.concat(F.lit("C"), F.col("ctx").cast("string"))]
    return joined.select("alignment", "ctx", "node_no", F.concat_ws("\t", *cells).alias("value"))


def edit_lines(edits: DataFrame) -> DataFrame:
    """(alignment, ctx, organism, value): a line for each edit, with its alignment and context."""
    at = F.when(F.col("edit").isin("intronify", "exonify"), F.format_string("%d..%d", "donor", "acceptor")).otherwise(F.concat_ws("\t", F.coalesce("donor", "acceptor").cast("string"), F.col("shift").cast("string")))
    cells = [F.lit("#REANNOTATE"), F.col("organism"), F.col("edit"), at, F.col("alignment"), F.concat(F.lit("C"), F.col("ctx").cast("string"))]
    return edits.select("alignment", "ctx", "organism", F.concat_ws("\t", *cells).alias("value"))


def file_lines(edits: DataFrame, folder: str) -> DataFrame:
    """(alignment, ctx, organism, value): for each edited gene where it was written, placed behind its last edit."""
    at = lambda kind: F.concat(F.lit(f"{folder}/{kind}/organism="), F.col("organism"))
    last = edits.groupBy("alignment", "organism").agg(F.max("ctx").alias("ctx"))
    return last.select("alignment", "ctx", "organism", F.concat_ws("\t", F.lit("#FILE"), "organism", "alignment", at("fasta"), at("gff")).alias("value"))


def in_order(ancestral: DataFrame, histories: DataFrame, edits: DataFrame, header: str | None = None, files: DataFrame | None = None) -> DataFrame:
    """The reports' lines, context by context, after a header."""
    none = F.lit(None)
    parts = [
        ancestral.select("alignment", "ctx", F.lit(0).alias("part"), none.cast("int").alias("node_no"), none.cast("string").alias("organism"), "value"),
        histories.select("alignment", "ctx", F.lit(1).alias("part"), "node_no", none.cast("string").alias("organism"), "value"),
        edits.select("alignment", "ctx", F.lit(2).alias("part"), none.cast("int").alias("node_no"), "organism", "value"),
    ]
    if files is not None:
        parts.append(files.withColumn("part", F.lit(3)))
    if header is not None:
        parts.append(ancestral.sparkSession.range(1).select(F.lit(header).alias("value")))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return every.orderBy("alignment", "ctx", "part", "node_no", "organism", "value")


def codon_lines(counts: DataFrame) -> DataFrame:
    """(organism, value): a line for each codon with its counts as first, middle and last."""
    n = lambda c: F.coalesce(F.sum(F.when(F.col("class") == c, F.col("n"))), F.lit(0)).cast("string")
    return counts.groupBy("organism", "codon_idx").agg(F.concat_ws("\t", n("first"), n("middle"), n("last")).alias("_n")).select("organism", F.concat_ws("\t", codon_text("codon_idx"), "_n").alias("value"))


def histogram_lines(histogram: DataFrame) -> DataFrame:
    return histogram.select("organism", F.concat_ws("\t", F.concat(F.lit("#"), F.upper("kind")), F.col("value").cast("string"), F.col("n").cast("string")).alias("value"))


def elided(sequence: Column, kept: int = 60) -> Column:
    """A sequence in lower case; of one that is longer than 2 * kept + 10 the ends, with the number of bases left out between."""
    low, left_out = F.lower(sequence), F.length(sequence) - 2 * kept
    return F.when(left_out > 10, F.concat(F.left(low, F.lit(kept)), F.lit(".."), left_out.cast("string"), F.lit(".."), F.right(low, F.lit(kept)))).otherwise(low)


def decimal(n: Column, total: Column, places: int = 0) -> Column:
    """n / total as text with so many places, halves upwards; - where total is 0. n and total are whole numbers and so is the
    arithmetic, so that no rounding of doubles shows."""
    div = lambda a, b: F.call_function("div", a, b)
    one = 10**places
    scaled = div(2 * one * n.cast("bigint") + total, 2 * total.cast("bigint"))
    text = scaled.cast("string") if places == 0 else F.concat(div(scaled, F.lit(one)).cast("string"), F.lit("."), F.lpad((scaled % one).cast("string"), places, "0"))
    return F.when(total > 0, text).otherwise("-")


def measure(x: Column, places: int) -> Column:
    return F.when(x.isNotNull(), F.format_string(f"%.{places}f", x)).otherwise("-")


CLASSES = ("first", "middle", "last")


def _of_class(cell: Column) -> list[Column]:
    """A codon's cells as first, middle and last; - for classes that an organism lacks."""
    return [F.coalesce(F.max(F.when(F.col("class") == c, cell)), F.lit("-")) for c in CLASSES]


def codon_frequency_lines(scores: DataFrame) -> DataFrame:
    """(organism, codon_idx, value): a line for each codon, with its counts as first, middle, last and under the null model, their
    shares and the scores; behind them (64) one with the three classes' expected scores in milli-bans."""
    per = Window.partitionBy("organism", "class")
    rows = scores.withColumns({"_t1": F.sum("n1").over(per), "_t0": F.sum("n0").over(per)})
    share = lambda n, t: F.concat(decimal(100 * F.col(n), F.col(t), 2), F.lit("%"))
    cells = [*_of_class(F.col("n1").cast("string")), F.max("n0").cast("string"), *_of_class(share("n1", "_t1")), F.max(share("n0", "_t0")), *_of_class(F.col("score").cast("string"))]
    lines = rows.groupBy("organism", "codon_idx").agg(F.concat_ws("\t", *cells).alias("_v")).select("organism", "codon_idx", F.concat_ws("\t", codon_text("codon_idx"), "_v").alias("value"))
    kl = scoring.divergence(scores, ["organism", "class"])
    means = kl.groupBy("organism").agg(F.concat_ws("\t", F.lit("#expected"), *_of_class(measure(F.col("kl") / F.lit(scoring.SCALES["millibans"]), 3))).alias("value"))
    return lines.unionByName(means.select("organism", F.lit(64).alias("codon_idx"), "value"))


def codon_score_lines(scores: DataFrame) -> DataFrame:
    """(organism, codon_idx, value): a line for each codon with its scores as first, middle and last."""
    cells = F.concat_ws("\t", *_of_class(F.col("score").cast("string")))
    return scores.groupBy("organism", "codon_idx").agg(cells.alias("_v")).select("organism", "codon_idx", F.concat_ws("\t", F.lit("#CODON"), codon_text("codon_idx"), "_v").alias("value"))


def site_lines(motifs: DataFrame, edges: DataFrame, unread: DataFrame, donor: bool, motif_length: int) -> DataFrame:
    """(organism, part, at, value): the composition and the scores of donors or acceptors.

    motifs and edges: score tables; unread: (organism, n), sites whose motif is ambiguous or doesn't fit. Parts: `motif` and
    `boundary` have counts and shares, read along the gene; `motif score` and `boundary score` the scores; of each the
    divergence from the null model in nats, in `total` (at 0) their sum in milli-bans. at: the motif's index, or the place."""
    read = from_base4("motif_idx", motif_length)
    shown = F.concat(F.lit("["), read) if donor else F.concat(reverse_complement(read), F.lit("]"))
    seen = motifs.where("n1 > 0")
    side = "5'" if donor else "3'"
    mark = lambda text: F.lit(f"#SPLICE {side}{text}")
    line = lambda rows, part, at, *cells: rows.select("organism", F.lit(part).alias("part"), at.cast("int").alias("at"), F.concat_ws("\t", *cells).alias("value"))
    per = edges.withColumn("_t", F.sum("n1").over(Window.partitionBy("organism", "place")))
    four = per.groupBy("organism", "place").agg(F.array_sort(F.collect_list(F.struct("nuc_idx", "n1", "score", "_t"))).alias("x"))
    place = F.col("place") + motif_length
    letters = NUCLEOTIDES if donor else NUCLEOTIDES.translate(str.maketrans("ACGT", "TGCA"))
    of = lambda names, cell: F.array_join(F.transform("x", lambda x: F.concat(F.substring(F.lit(names), x["nuc_idx"] + 1, F.lit(1)), F.lit(" "), cell(x))), "\t")
    shares = F.array_join(F.transform("x", lambda x: decimal(x["n1"], x["_t"], 3)), "\t")
    offset = place if donor else -place
    motif_kl, edge_kl = scoring.divergence(motifs, ["organism"]), scoring.divergence(edges, ["organism", "place"])
    both = motif_kl.select("organism", "kl").unionByName(edge_kl.select("organism", "kl"))
    total = both.groupBy("organism").agg(F.when(F.count("*") == F.count("kl"), F.sum("kl") / F.lit(scoring.SCALES["millibans"])).alias("kl"))
    parts = [
        line(seen, "motif", F.col("motif_idx"), F.concat(F.lit("#SSC motif "), shown), F.col("n1").cast("string")),
        line(unread, "motif", F.lit(-1), F.lit("#SSC motif null"), F.col("n").cast("string")),
        line(four, "boundary", F.col("place"), F.concat(F.lit("#SSC bndry "), offset.cast("string")), of(letters, lambda x: x["n1"].cast("string")), shares),
        line(seen, "motif score", F.col("motif_idx"), F.concat(mark("mot "), read if donor else reverse_complement(read)), F.col("n1").cast("string"), F.col("score").cast("string")),
        line(motif_kl, "motif score", F.lit(-1), mark("mot KL"), measure(F.col("kl"), 4)),
        line(four.join(edge_kl, ["organism", "place"]), "boundary score", F.col("place"), F.concat(mark("++" if donor else "--"), F.col("place").cast("string")),
             of(NUCLEOTIDES, lambda x: F.concat_ws("/", x["n1"].cast("string"), x["score"].cast("string"))), F.concat(F.lit("KL "), measure(F.col("kl"), 4))),
        line(total, "total", F.lit(0), mark("KLmbans"), measure(F.col("kl"), 3)),
    ]
    return reduce(DataFrame.unionByName, parts)


def substitution_lines(scores: DataFrame) -> DataFrame:
    """(org_a, org_b, codon_a, value): of each pair of organisms a line for each codon, with its own score and those of what it may
    become, in the codons' order; behind them (64) the expected score."""
    row = F.transform(F.array_sort(F.collect_list(F.struct("codon_b", "score"))), lambda x: x["score"].cast("string"))
    lines = scores.groupBy("org_a", "org_b", "codon_a").agg(F.concat_ws("\t", F.first("own").cast("string"), row).alias("_v"))
    mean = scores.groupBy("org_a", "org_b").agg(F.first("expected").alias("_e"))
    return lines.select("org_a", "org_b", "codon_a", F.concat_ws("\t", codon_text("codon_a"), "_v").alias("value")).unionByName(
        mean.select("org_a", "org_b", F.lit(64).alias("codon_a"), F.concat_ws("\t", F.lit("#expected"), measure(F.col("_e"), 3)).alias("value"))
    )


def length_lines(histogram: DataFrame, transitions: DataFrame) -> DataFrame:
    """(organism, part, value): of each organism a `tally` of genes, exons and introns (exon lengths in codons), and a line for
    each phase before (-1: none) with how often which phase follows."""
    n, v, k = F.col("n"), F.col("value"), F.col("kind")
    total = lambda kind, x: F.coalesce(F.sum(F.when(k == kind, x)), F.lit(0))
    sums = histogram.groupBy("organism").agg(
        total("exon_count", n).alias("genes"), total("intron_length", n).alias("introns"), total("intron_length", n * v).alias("bases"), total("exon_length", n).alias("exons"), total("exon_length", n * v).alias("coding"),
        F.max_by(F.when(k == "intron_length", v), F.when(k == "intron_length", F.struct(n, -v))).alias("typical"),
    )
    phases = transitions.groupBy("organism").agg(*(F.coalesce(F.sum(F.when(F.col("phase") == p, n)), F.lit(0)).alias(f"p{p}") for p in range(3)))
    whole = lambda p: F.concat(F.lit(f"ph{p} "), F.col(p_ := f"p{p}").cast("string"), F.lit("="), decimal(100 * F.col(p_), F.col("introns")), F.lit("%"))
    named = lambda name, x: F.concat(F.lit(f"{name} "), x)
    text = lambda c: F.col(c).cast("string")
    filled = sums.join(phases, "organism", "left").fillna(0, ["p0", "p1", "p2"])
    tally = filled.select("organism", F.lit("tally").alias("part"), F.concat_ws(
        "\t", F.lit("#TALLY"), "organism", named("ngenes", text("genes")), named("nintrons", text("introns")), F.concat_ws(", ", whole(1), whole(2), whole(0)),
        named("intr/gene", decimal(F.col("introns"), F.col("genes"), 3)), named("tot_intron_len", text("bases")), named("avg_ilen", decimal(F.col("bases"), F.col("introns"), 3)), named("typical", F.coalesce(text("typical"), F.lit("-"))),
        named("tot_exon_len", decimal(F.col("coding"), F.lit(3), 3)), named("nexons", text("exons")), named("avg_elen", decimal(F.col("coding"), 3 * F.col("exons"), 3))).alias("value"))
    each = transitions.groupBy("organism", "before").agg(F.sum("n").alias("t"), *(F.coalesce(F.sum(F.when(F.col("phase") == p, n)), F.lit(0)).alias(f"t{p}") for p in range(3)))
    cell = lambda p: F.concat(F.lit(f"t{p} "), text(f"t{p}"), F.lit(" ("), decimal(100 * F.col(f"t{p}"), F.col("t")), F.lit("%)"))
    moved = each.select("organism", text("before").alias("part"), F.concat_ws("\t", F.lit("#TRANSITION"), "organism", text("before"), cell(0), cell(1), cell(2)).alias("value"))
    return tally.unionByName(moved)


#: The marks of the gap report's lines in their order.
GAP_MARKS = ("#TALLY", "#STATISTICS", "#INSERT", "#DELETE", "#MATCH", "#UP", "#DOWN")


def gap_lines(walked: DataFrame) -> DataFrame:
    """(pair, part, side, phase, length, value) of aligned sequences (alignment, seq_idx, organism, residues, offsets, introns): a
    tally of phases for each organism; for each pair of organisms the lengths of runs, the distances of introns to gaps, and
    a total of each (length null). Sort by all columns but the last."""
    pairs = evaluated(alignment.sequence_pairs(walked, ["organism", "residues", "introns"]), states=alignment.gap_states("residues_1", "residues_2"))
    pairs = pairs.withColumn("pair", F.concat_ws("/", "organism_1", "organism_2"))
    no = lambda: F.lit(None).cast("int")
    kind = F.create_map(*(F.lit(x) for kv in (("I", "#INSERT"), ("D", "#DELETE"), ("M", "#MATCH")) for x in kv))[F.col("kind")]
    runs = alignment.run_lengths(pairs, ["pair"]).select("pair", kind.alias("mark"), no().alias("side"), no().alias("phase"), "length", "n")
    sides = F.array(*(F.struct(F.lit(k).alias("side"), alignment.gap_distances(F.col("states"), F.col(f"introns_{k}")).alias("d")) for k in (1, 2)))
    each = pairs.select("pair", F.inline(sides)).select("pair", "side", F.inline("d"))
    ways = F.array(F.struct(F.lit("#UP").alias("mark"), F.col("up").alias("length")), F.struct(F.lit("#DOWN").alias("mark"), F.col("down").alias("length")))
    distances = each.select("pair", "side", "phase", F.inline(ways)).where("length is not null").groupBy("pair", "mark", "side", "phase", "length").agg(F.count("*").alias("n"))
    counts = runs.unionByName(distances)
    totals = counts.groupBy("pair", "mark", "side", "phase").agg(F.sum("n").alias("n")).withColumn("length", no())
    place = F.when(F.col("side").isNotNull(), F.format_string("%d.ph%d", "side", "phase"))
    lines = counts.unionByName(totals).withColumn("value", F.concat_ws("\t", "mark", "pair", place, F.coalesce(F.col("length").cast("string"), F.lit("total")), F.col("n").cast("string")))
    heads = pairs.select("pair").distinct().select("pair", F.lit("#STATISTICS").alias("mark"), F.concat_ws("\t", F.lit("#STATISTICS"), "pair").alias("value"))
    placed = lambda k: F.sum(F.size(F.filter("introns", lambda i: i["phase"] == k)))
    tally = walked.groupBy("organism").agg(placed(1).alias("p1"), placed(2).alias("p2"), placed(3).alias("p3"), F.count("*").alias("genes"), F.sum(F.size("offsets")).alias("all"))
    text = lambda c: F.col(c).cast("string")
    cells = [F.lit("#TALLY"), F.col("organism"), text("p1"), text("p2"), text("p3"), (F.col("p1") + F.col("p2") + F.col("p3")).cast("string"), F.concat(F.lit("// ngenes "), text("genes"), F.lit(", totintr "), text("all"), F.lit(", avgpergene "), decimal(F.col("all"), F.col("genes"), 3))]
    tallies = tally.select(F.col("organism").alias("pair"), F.lit("#TALLY").alias("mark"), F.concat_ws("\t", *cells).alias("value"))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [lines.drop("n"), heads, tallies])
    part = F.array_position(F.array(*map(F.lit, GAP_MARKS)), F.col("mark")).cast("int")
    return every.select("pair", part.alias("part"), "side", "phase", "length", "value")


def in_gap_order(lines: DataFrame) -> DataFrame:
    """The tallies, then pair by pair; lengths as numbers, totals behind them."""
    return lines.orderBy(F.col("part") > 1, "pair", F.greatest("part", F.lit(1)), "side", "phase", F.col("length").asc_nulls_last()).select("value")


def gene_lines(members: DataFrame) -> DataFrame:
    """(alignment, seq_idx, value): a line for each aligned sequence's gene."""
    about = genes.short_text(F.col("accno"), F.col("chrom"), F.col("strand"), F.col("exons"), True)
    return members.select("alignment", "seq_idx", F.concat_ws("\t", F.lit("#GENE"), F.col("seq_idx").cast("string"), F.concat(F.lit("organism "), F.col("organism")), about, F.concat(F.lit("defline "), F.col("defline"))).alias("value"))


def intron_lines(members: DataFrame) -> DataFrame:
    """(alignment, seq_idx, nth, value): a line for each intron of each aligned sequence's gene, in ascending order of position;
    members with `cut`, the introns' sequences."""
    rows = members.select("alignment", "seq_idx", "organism", F.posexplode("cut").alias("nth", "_s"))
    return rows.select("alignment", "seq_idx", "nth", F.concat_ws("\t", F.lit("#INTRON"), F.col("seq_idx").cast("string"), "organism", F.col("nth").cast("string"), elided(F.col("_s"))).alias("value"))


def alignment_lines(walked: DataFrame) -> DataFrame:
    """(alignment, col, value): a line for each column of an alignment, with a cell for each sequence in their order: position of
    the codon, codon and residue, and the phase of an intron. walked: (alignment, seq_idx, strand, exons, codons, introns,
    taken), taken being the columns that hold a codon. An alignment has as many sequences as there are organisms."""
    phase = lambda c: F.get(F.filter("introns", lambda i: i["col"] == c), 0)["phase"]
    number = lambda c: F.array_position("taken", c).cast("int") - 1
    at = lambda c: F.when(number(c) >= 0, genes.position_of_offset(F.col("exons"), F.col("strand"), 3 * number(c)))
    cells = F.transform("codons", lambda x, c: cell_text(at(c), x, phase(c)))
    rows = walked.select("alignment", "seq_idx", cells.alias("cells")).groupBy("alignment").agg(F.array_sort(F.collect_list(F.struct("seq_idx", "cells"))).alias("rows"))
    width = F.array_max(F.transform("rows", lambda r: F.size(r["cells"])))
    column = lambda c: F.concat_ws("\t", F.lit("#ALIGNMENT"), c.cast("string"), F.transform("rows", lambda r: F.coalesce(F.get(r["cells"], c), F.lit(""))))
    lines = F.transform(F.sequence(F.lit(0), width - 1), column)
    return rows.where(width > 0).select("alignment", F.posexplode(lines).alias("col", "value"))
