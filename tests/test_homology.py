"""Brackets, contexts and reconstruction on alignments whose history is known, and the commands end to end."""

import os
import random

import duckdb
import numpy as np
import pytest
from exonia import cli
from exonia.functions.seq import code_by_index
from exonia.operators import alignment, homology, parsimony, scoring
from exonia.plans import history as plan
from pyspark.sql import functions as F

CODE = code_by_index()
BASES = "AGCT"
CODONS = {}
for i, residue in enumerate(CODE):
    CODONS.setdefault(residue, "".join(BASES[i >> k & 3] for k in (4, 2, 0)))
TREE = [("a", "x"), ("b", "x"), ("x", "r"), ("c", "r"), ("r", None)]
FLANK = "TTACCATTGCA" * 10


def gene(protein, introns, strand="+", filler="GT" + "ACTGA" * 8 + "AG"):
    """(contig, exons) of a protein whose gene has introns after the given coding offsets."""
    coding = "".join(CODONS[r] for r in protein)
    text, exons, at = FLANK, [], 0
    for stop in [*introns, len(coding)]:
        exons.append((len(text), len(text) + stop - at))
        text += coding[at:stop]
        at = stop
        if stop < len(coding):
            text += filler
    text += FLANK
    if strand == "-":
        text = text.translate(str.maketrans("ACGT", "TGCA"))[::-1]
        exons = [(len(text) - e, len(text) - s) for s, e in exons][::-1]
    return text, exons


def scores(names):
    table = np.full((64, 64), -300)
    np.fill_diagonal(table, 900)
    n = len(names)
    return homology.Scores(names, np.broadcast_to(table, (n, n, 64, 64)), np.full((n, n), 600.0), np.zeros((n, 64), int))


def members(layout, protein, strands="+++"):
    out = []
    for name, introns, strand in zip("abc", layout, strands, strict=True):
        text, exons = gene(protein, introns, strand)
        out.append(homology.walk(protein, exons, strand, text, 0, name))
    return out


PROTEIN = "M" + "".join(random.Random(8).choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(60))


def history(layout, strands="+++"):
    m = members(layout, PROTEIN, strands)
    s = scores(list("abc"))
    found = homology.contexts(m, s)
    sites = [homology.collected(m, c, s) for c in found]
    return m, found, sites


def test_a_shared_intron_is_conserved():
    for strands in ("+++", "-+-", "---"):
        for offset in (90, 91, 92):
            m, found, sites = history([[offset]] * 3, strands)
            assert len(found) == 1 and sites[0] is not None
            labels, cost = parsimony.label(TREE, homology.leaf_states(sites[0], m, parsimony.Penalties()))
            assert cost == 0 and all(parsimony.has_intron(labels[n]) for n in labels)
            assert list(homology.edits(sites[0], m, labels)) == []


def test_a_lone_intron_is_a_gain():
    for strands in ("+++", "+-+"):
        m, found, sites = history([[], [90], []], strands)
        # Two losses are cheaper than a gain unless losses are made dear.
        for p, want, total in ((parsimony.Penalties(), ("C5,C3", "Ls"), 10), (parsimony.Penalties(loss=20), ("Gn", "NO"), 12)):
            labels, cost = parsimony.label(TREE, homology.leaf_states(sites[0], m, p), p)
            events = {n: parsimony.event(labels[n], labels[parent] if parent else labels[n]) for n, parent in TREE}
            assert (events["b"], events["a"]) == want and cost == total


def test_far_introns_make_two_contexts_and_near_ones_one():
    assert len(history([[60], [60], [150]])[1]) == 2
    m, found, _ = history([[90], [93], []])
    assert len(found) == 1 and found[0].first < 30 < found[0].last


def test_codons_and_introns_in_columns():
    protein = "MK-CX" + "A" * 4
    text, exons = gene(protein.replace("-", "").replace("X", "A"), [6, 10])
    m = homology.walk(protein, exons, "+", text, 0, "a")
    assert m.phase == [0, 3, 0, 0, 1, 0, 0, 0, 0] and m.position[2] is None
    assert [m.read(p, 3) for p in m.position if p is not None][:2] == [CODONS["M"], CODONS["K"]]


def test_bracket_without_anything_to_find():
    m = members([[90], [], []], PROTEIN)
    m[1].codon = [None] * len(m[1].codon)
    b = homology.bracket(m[0], m[1], 29, scores(list("abc")))
    assert not b.valid and (b.left, b.right) == (-1, -1)


def test_edited_exons_match_the_inferred_state():
    exons = [(10, 40), (70, 100)]
    for strand in "+-":
        donor, acceptor = (40, 69) if strand == "+" else (69, 40)
        one = homology.edited(exons, strand, "exonify", donor, acceptor)
        assert one == [(10, 100)] and homology.edited(one, strand, "intronify", donor, acceptor) == exons
    assert homology.edited(exons, "+", "donor", 43, None) == [(10, 43), (70, 100)]
    assert homology.edited(exons, "+", "acceptor", None, 66) == [(10, 40), (67, 100)]
    assert homology.edited(exons, "-", "donor", 66, None) == [(10, 40), (67, 100)]
    assert homology.edited(exons, "-", "acceptor", None, 43) == [(10, 43), (70, 100)]


def gap_machine(a, b, introns_a, introns_b):
    """Runs and distances, column by column."""
    runs, ups, downs = [], [], []
    kept = [(c, "I" if x == "-" else "D" if y == "-" else "M") for c, (x, y) in enumerate(zip(a, b, strict=True)) if not x == y == "-"]
    for k, (c, s) in enumerate(kept):
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
        for side, own in ((1, introns_a), (2, introns_b)):
            for phase in [p for col, p in own if col == c]:
                rest = 0
                while k + 1 + rest < len(kept) and kept[k + 1 + rest][1] == "M":
                    rest += 1
                if s == "M":
                    ups.append((side, phase, runs[-1][1]))
                    downs.append((side, phase, rest + (phase < 3)))
                else:
                    ups.append((side, phase, 0))
                    if phase < 3:
                        downs.append((side, phase, 0))
                    elif k + 1 < len(kept):
                        downs.append((side, phase, rest))
    return sorted(map(tuple, runs)), sorted(ups), sorted(downs)


def test_gap_statistics(spark):
    r = random.Random(9)
    data, want = [], []
    for i in range(80):
        n = r.randint(1, 30)
        a, b = ("".join(r.choice("--AC") for _ in range(n)) for _ in range(2))
        own = [[(c, r.randint(1, 3)) for c in range(n) if s[c] != "-" and r.random() < 0.3] for s in (a, b)]
        data.append((i, a, b, *own))
        want.append(gap_machine(a, b, *own))
    kind = "array<struct<col:int,phase:int>>"
    df = spark.createDataFrame(data, f"i int, a string, b string, x {kind}, y {kind}").withColumn("states", alignment.gap_states("a", "b"))
    got = df.select("i", alignment.gap_distances(F.col("states"), F.col("x")).alias("x"), alignment.gap_distances(F.col("states"), F.col("y")).alias("y")).collect()
    runs = {}
    for r_ in alignment.run_lengths(df, ["i"]).collect():
        runs.setdefault(r_.i, []).extend([(r_.kind, r_.length)] * r_.n)
    for x in got:
        both = [(side, d.phase, d.up, d.down) for side, own in ((1, x.x), (2, x.y)) for d in own]
        assert sorted(runs.get(x.i, [])) == want[x.i][0]
        assert sorted((s, p, u) for s, p, u, _ in both) == want[x.i][1]
        assert sorted((s, p, d) for s, p, _, d in both if d is not None) == want[x.i][2]


def test_substitution_scores_of_stops(spark):
    pairs = spark.createDataFrame([("a", "b", 0, 0, 5), ("a", "b", 0, 1, 1), ("a", "b", 48, 48, 3)], "org_a string, org_b string, codon_a int, codon_b int, n bigint")
    null = spark.createDataFrame([(o, i, 1) for o in "ab" for i in range(64)], "organism string, codon_idx int, n bigint")
    got = {(r.codon_a, r.codon_b): r for r in scoring.substitution_scores(pairs, null).collect()}
    assert len(got) == 4096 and got[48, 48].score == 0 and got[48, 0].score == scoring.NEVER and got[0, 48].score == scoring.NEVER
    assert got[0, 0].score > got[0, 1].score > scoring.NEVER and got[5, 5].score == scoring.NEVER
    assert got[0, 0].expected == (5 * got[0, 0].score + got[0, 1].score) / 6


def test_alignments_with_several_sequences_of_an_organism(spark):
    rows = []
    for alignment_, names in (("single", "abc"), ("double", "aabc"), ("other", "abcxx")):
        for k, name in enumerate(names):
            text, exons = gene(PROTEIN, [90 + 3 * (k == 1 and alignment_ == "double")])
            rows.append((alignment_, name, "+", exons, PROTEIN, text, 0))
    df = spark.createDataFrame(rows, "alignment string, organism string, strand string, exons array<struct<start: int, end: int>>, residues string, dna string, origin int")
    every = homology.reconstructed(df, scores(list("abc")), TREE)
    for what in ("contexts", "nodes"):
        assert {r.alignment for r in homology.part(every, what).collect()} == {"single", "other"}
    assert [tuple(r) for r in homology.doubled(df, list("abc")).collect()] == [("double", "a", 2)]


def write_inputs(tmp):
    """Genomes, GFF, alignments and a tree of three organisms; gene g1 of b has an intron that the others lack."""
    r = random.Random(12)
    names, genomes, gffs = "abc", [], []
    proteins = ["M" + "".join(r.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(70)) for _ in range(6)]
    fasta = {k: [] for k in range(6)}
    for o, org in enumerate(names):
        contigs, lines = [], []
        for k, p in enumerate(proteins):
            introns = [90 + k % 3] if org == "b" or k > 0 else []
            # Introns must show every codon somewhere, or their scores are infinite.
            filler = "GT" + "".join(r.choice("ACGT") for _ in range(397)) + "AG"
            text, exons = gene(p, introns, "+-"[(o + k) % 2], filler)
            contigs.append(f">c{k} /organism={org}\n;note\n" + "\n".join(text[i : i + 60].lower() for i in range(0, len(text), 60)))
            lines += [f"c{k}\tx\tCDS\t{s + 1}\t{e}\t.\t{'+-'[(o + k) % 2]}\t.\tID=cds:g{k}" for s, e in exons]
            fasta[k].append(f">{org}|g{k} /organism={org}\n{p}")
        (tmp / f"{org}.fa").write_text("\n".join(contigs) + "\n")
        (tmp / f"{org}.gff").write_text("##gff-version 3\n" + "\n".join(lines) + "\n")
        genomes.append(f"{org}={tmp}/{org}.fa")
        gffs.append(f"{org}={tmp}/{org}.gff")
    for k, recs in fasta.items():
        (tmp / f"og{k}.fasta").write_text("\n".join(recs) + "\n")
    (tmp / "t.tre").write_text("((a:1,b:1)x:1,c:1)r;")
    return ",".join(genomes), ",".join(gffs), [f"{tmp}/og{k}.fasta" for k in range(6)]


def test_commands_end_to_end(spark, tmp_path):
    genomes, gffs, alignments = write_inputs(tmp_path)
    run = lambda *a: cli.main([str(x) for x in a])
    read = lambda p: [r.value for r in spark.read.text(str(p)).collect()]
    run("extract-annotations", "gff3", genomes, gffs, "-o", tmp_path / "ann")
    lines = read(tmp_path / "ann")
    assert len(lines) == 19 and sum(x.startswith("seq\tgene\taccno") for x in lines) == 1 and any("\tb|g0\t" in x for x in lines)
    (tmp_path / "ann.txt").write_text("\n".join("#" + x if x.startswith("seq\t") else x for x in lines) + "\n")
    run("collect-statistics", genomes, tmp_path / "ann.txt", *alignments, "-o", tmp_path / "model.txt")
    assert (tmp_path / "model.txt").read_text().endswith("#END\n")
    run("check-sites", genomes, tmp_path / "ann.txt", tmp_path / "model.txt", tmp_path / "t.tre", *alignments, "--loss", 20, "-o", tmp_path / "sites", "--save", tmp_path / "saved", "--showali")
    nodes = spark.read.parquet(str(tmp_path / "sites/nodes"))
    by = {(r.alignment, r.node): r.event for r in nodes.collect()}
    assert by["og0", "b"] == "Gn" and by["og1", "b"] == "C5,C3"
    report = read(tmp_path / "sites/report")
    assert report[0].startswith("#ANCESTRAL\ta\tb\tx") and report[1].endswith("\tog0\tC0")
    leaf = next(x for x in report if x.startswith("#HISTORY leaf b\t") and "\tog0\t" in x).split("\t")
    own = next(r for r in nodes.where("alignment = 'og0' and node = 'b'").collect())
    assert leaf[1] == f"{own.own_donor}..{own.own_acceptor}/{own.phase}" and leaf[5:7] == ["+0,+0", "ss:GT-AG"]
    assert [x.split("\t")[0] for x in report if x.endswith("\tog0\tC0")] == ["#ANCESTRAL", *(f"#HISTORY {k} {n}" for k, n in (("leaf", "a"), ("leaf", "b"), ("node", "x"), ("leaf", "c"), ("node", "r")))]
    shown = read(tmp_path / "sites/alignments")
    assert sum(x.startswith("#GENE\t") for x in shown) == 18 and any(x.startswith("#ALIGNMENT\t0\t") and len(x.split("\t")) == 5 for x in shown)
    assert all(x.split("\t")[4].startswith("gt") and x.endswith("ag") and "..281.." in x for x in shown if x.startswith("#INTRON"))
    edited = {tuple(x.split("\t")[1:5:3]) for x in report if x.startswith("#REANNOTATE\t")}
    assert {(x.split("\t")[1]) for x in report if x.startswith("#FILE\t")} == {o for o, _ in edited}
    run("count-gaps", genomes, tmp_path / "ann.txt", *alignments, "-o", tmp_path / "gaps")
    gaps = read(tmp_path / "gaps")
    assert "#MATCH\tb/a\t71\t6" in gaps and any(x.startswith("#TALLY\tb\t") for x in gaps)
    own = [x.split("\t") for x in gaps if x.startswith("#MATCH\tb/a\t")]
    assert gaps[0].startswith("#TALLY\ta") and [x[2] for x in own] == [*sorted((x[2] for x in own[:-1]), key=int), "total"] and int(own[-1][3]) == sum(int(x[3]) for x in own[:-1])
    run("genomic-context", genomes, tmp_path / "ann.txt", alignments[0], "-o", tmp_path / "context")
    text = "\n".join(read(tmp_path / "context"))
    assert text.count(">") == 3 and "/region=c0:11.." in text


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_histories_of_the_tables_by_sql(spark):
    """Costs, events and edited genes of every context of the given tables, computed again by SQL from states and exons."""
    sf = "/root/testdata/sf0.01"
    tree = plan.trees.collected(plan.table(spark, sf, "phylo_edge"))
    members = plan.members(spark, sf)
    every = homology.reconstructed(members, plan.scores_of(spark, sf), tree).persist()
    con = duckdb.connect()
    for name in ("nodes", "edits", "contexts"):
        frame = homology.part(every, name).toPandas()
        assert len(frame)
        con.register(name, frame)
    con.register("genes", members.selectExpr("alignment", "organism", "strand", "transform(exons, e -> e.start) AS s", "transform(exons, e -> e.end) AS e").toPandas())
    con.execute("""CREATE VIEW branch AS SELECT n.*, p.state AS pstate, p.donor AS pd, p.acceptor AS pa FROM nodes n LEFT JOIN nodes p ON n.alignment = p.alignment AND n.ctx = p.ctx AND n.parent = p.node""")
    # What the branches cost; the rest of the total is what leaves pay for other than annotated sites: 1 or 2 each.
    over = con.sql(f"""
      SELECT alignment, ctx, any_value(cost) - sum(CASE WHEN pstate IS NULL OR state = 'missing' THEN 0 WHEN pstate = 'missing' THEN {23 * len(tree)} WHEN state = 'none' THEN CASE pstate WHEN 'intron' THEN 5 ELSE 0 END
        WHEN pstate <> 'intron' THEN 12 ELSE 5 * ((donor <> pd)::INT + (acceptor <> pa)::INT) END) AS rest,
        count(*) FILTER (WHERE is_leaf AND state <> 'missing') AS leaves,
        sum(CASE WHEN own_donor IS NOT NULL AND donor_shift IS NOT NULL THEN (donor_shift <> 0)::INT + (acceptor_shift <> 0)::INT ELSE 0 END) AS moved
      FROM branch GROUP BY ALL HAVING rest < moved OR rest > moved + 2 * leaves""").fetchall()
    assert over == []
    wrong = con.sql(r"""
      SELECT * FROM branch WHERE regexp_replace(event, '\(\d+\)', '', 'g') NOT IN (
        CASE WHEN state = 'missing' THEN 'na' WHEN state = 'none' THEN CASE WHEN pstate = 'intron' THEN 'Ls' ELSE 'NO' END WHEN coalesce(pstate, state) <> 'intron' THEN 'Gn' ELSE
          CASE WHEN coalesce(pd, donor) = donor THEN 'C5' WHEN (donor - pd) * (acceptor - donor) > 0 THEN 'E5' ELSE 'I5' END || ',' ||
          CASE WHEN coalesce(pa, acceptor) = acceptor THEN 'C3' WHEN (acceptor - pa) * (acceptor - donor) > 0 THEN 'I3' ELSE 'E3' END END)""").fetchall()
    assert wrong == []
    # The first edit of a gene, by exons as sets of bases: an intron that goes adds its bases, one that comes takes them away.
    first = con.sql("""
      WITH f AS (SELECT * FROM edits QUALIFY row_number() OVER (PARTITION BY alignment, organism ORDER BY ctx) = 1 AND count(*) OVER (PARTITION BY alignment, organism, ctx) = 1),
      x AS (SELECT f.*, list_sum(g.e) - list_sum(g.s) AS before, list_sum(string_split(exon_ends, ',')::BIGINT[]) - list_sum(string_split(exon_starts, ',')::BIGINT[]) AS after, len(g.s) AS n, len(string_split(exon_starts, ',')) AS n_after
        FROM f JOIN genes g ON f.alignment = g.alignment AND f.organism = g.organism)
      SELECT edit, after - before, CASE edit WHEN 'exonify' THEN abs(acceptor - donor) + 1 WHEN 'intronify' THEN -abs(acceptor - donor) - 1 WHEN 'donor' THEN shift ELSE -shift END AS want,
        n_after - n, CASE edit WHEN 'exonify' THEN -1 WHEN 'intronify' THEN 1 ELSE 0 END AS want_n FROM x""").fetchall()
    assert all(got == want and n == want_n for _, got, want, n, want_n in first), first
    every.unpersist()
