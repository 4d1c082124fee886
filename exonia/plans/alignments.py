"""Queries on aligned proteins. Their genes are those of genepred. The tables hold no coding sequences: a protein's is made
from its residues, each by one of its codons, which differ between sequences with odd and even seq_idx."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from exonia.functions import seq as S
from exonia.operators import alignment, counting, genes, scoring
from exonia.plans import sequences as SQ
from exonia.plans.models import _GENE_OF
from exonia.plans.views import INTRON, models
from exonia.session import evaluated, few, stored, table

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, alignment, seq_idx, seq_id, organism, residues, gene_row): the last delivered row of each place in an
    alignment, with its gene's organism where its own is unknown."""
    t = table(spark, sf_dir, "genepred").select("row_id", "organism", "accno", "loaded_at")
    last = genes.last_wins(t, ["organism", "accno"], ["loaded_at", "row_id"])
    p = table(spark, sf_dir, "protein_sequence").select("row_id", "alignment", "seq_idx", "seq_id", "organism", "residues", "loaded_at")
    p = genes.last_wins(p, ["alignment", "seq_idx"], ["loaded_at", "row_id"])
    got = genes.with_gene(p, last)
    rows = got.select("row_id", "alignment", "seq_idx", "seq_id", F.coalesce("organism", "gene_row.organism").alias("organism"), "residues", F.col("gene_row.row_id").alias("gene_row"))
    # By alignment, as what follows groups them, and before the work on columns, which is heavy for its bytes.
    return rows.repartition("alignment")


def walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """members with a readable gene: with `offsets`, their introns' coding offsets, and `introns`, their columns."""
    own = models(spark, sf_dir).select(F.col("row_id").alias("gene_row"), F.transform(genes.introns(F.col("exons"), F.col("strand")), lambda i: i["cds_offset"]).alias("offsets"))
    rows = members(spark, sf_dir).where("organism is not null and residues is not null").join(own, "gene_row")
    return alignment.placed_introns(rows)


MEMBER = f"""{INTRON}, {_GENE_OF},
  member AS (
    SELECT p.row_id, alignment, seq_idx, seq_id, coalesce(p.organism, g.gene_organism) AS org, residues, g.gene_row
    FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY alignment, seq_idx ORDER BY loaded_at DESC, row_id DESC) AS kk FROM protein_sequence) WHERE kk = 1) p JOIN gene_of g ON p.row_id = g.row_id),
  wmember AS (SELECT * FROM member WHERE org IS NOT NULL AND residues IS NOT NULL AND gene_row IN (SELECT row_id FROM exon)),
  res AS (SELECT row_id, alignment, seq_idx, org, gene_row, col, substr(residues, col + 1, 1) AS ch FROM (SELECT *, unnest(range(0, length(residues))) AS col FROM wmember)),
  ranked AS (SELECT *, sum(CASE WHEN ch <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY row_id ORDER BY col) - 1 AS rank FROM res),
  placed AS (SELECT r.row_id, r.alignment, r.seq_idx, r.org, r.col, ((i.cds_offset - 1) % 3 + 1)::INT AS phase FROM ranked r JOIN intron i ON i.row_id = r.gene_row AND i.cds_offset > 0 AND (i.cds_offset - 1) // 3 = r.rank AND r.ch <> '-')"""


@query(f"WITH {MEMBER} SELECT row_id, alignment, col::INT AS col, phase FROM placed")
def aligned_introns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment columns and phases of introns."""
    return walked(spark, sf_dir).select("row_id", "alignment", F.inline("introns"))


@query(f"WITH {MEMBER}, t AS (SELECT m.alignment, m.row_id, (i.cds_offset - 1) // 3 AS codon, count(*) AS k FROM wmember m JOIN intron i ON i.row_id = m.gene_row AND i.cds_offset > 0 GROUP BY ALL) SELECT DISTINCT alignment FROM wmember WHERE alignment NOT IN (SELECT alignment FROM t WHERE k > 1)")
def usable_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments in which no gene has two introns in one codon."""
    w = walked(spark, sf_dir)
    return w.groupBy("alignment").agg(F.max(alignment.shares_codon(F.col("offsets"))).alias("bad")).where("not bad").select("alignment")


def codon_choices() -> dict[tuple[int, str], str]:
    """A codon for each residue, the first of its codons (0) or the last (1)."""
    code, out = S.code_by_index(), {}
    for i, residue in enumerate(code):
        codon = "".join(S.NUCLEOTIDES[i >> k & 3] for k in (4, 2, 0))
        out.setdefault((0, residue), codon)
        out[1, residue] = codon
    return out


def coding() -> Column:
    """A protein's stand-in coding sequence; residues that stand for no codon give NNN."""
    of = [F.create_map(*(F.lit(x) for (v, r), codon in codon_choices().items() if v == k for x in (r, codon))) for k in (0, 1)]
    residues = F.filter(alignment.letters("residues"), lambda c: c != "-")
    side = lambda k: F.array_join(F.transform(residues, lambda c: F.coalesce(F.try_element_at(of[k], c), F.lit("NNN"))), "")
    return F.when(F.col("seq_idx") % 2 == 0, side(0)).otherwise(side(1))


def with_codons(rows: DataFrame) -> DataFrame:
    """(alignment, organism, codons) of members."""
    return alignment.aligned_codons(evaluated(rows, coding=coding())).select("alignment", "organism", "codons")


_ORGANISMS = "(SELECT count(*) FROM phylo_edge WHERE node_name NOT IN (SELECT parent_name FROM phylo_edge WHERE parent_name IS NOT NULL))"
CODING = f"""
  choice AS (SELECT * FROM (VALUES {", ".join(f"({v}, '{r}', '{c}')" for (v, r), c in codon_choices().items())}) AS t(v, aa, codon)),
  coding AS (
    SELECT row_id, string_agg(coalesce(codon, 'NNN'), '' ORDER BY col) AS coding FROM (SELECT row_id, seq_idx, unnest(range(0, length(residues))) AS col, residues FROM member) r
    LEFT JOIN choice c ON c.v = seq_idx % 2 AND c.aa = substr(residues, col + 1, 1) WHERE substr(residues, col + 1, 1) <> '-' GROUP BY row_id)"""
_COLUMNS = f"""
  WITH {MEMBER}, {SQ.SEQ}, {CODING},
  cm AS (SELECT * FROM member WHERE org IS NOT NULL AND residues IS NOT NULL),
  per AS (SELECT alignment, org, count(*) AS k FROM cm GROUP BY ALL),
  fit AS (SELECT alignment FROM per GROUP BY alignment HAVING count(*) = {_ORGANISMS} AND max(k) = 1),
  cr AS (SELECT row_id, alignment, org, col, substr(residues, col + 1, 1) AS ch FROM (SELECT *, unnest(range(0, length(residues))) AS col FROM cm WHERE alignment IN (SELECT alignment FROM fit))),
  rr AS (SELECT *, regexp_matches(ch, '^[ABCDEFGHIKLMNPQRSTVWXYZ*]$') AS reg, sum(CASE WHEN regexp_matches(ch, '^[ABCDEFGHIKLMNPQRSTVWXYZ*]$') THEN 1 ELSE 0 END) OVER (PARTITION BY row_id ORDER BY col) - 1 AS r FROM cr),
  cd0 AS (SELECT rr.alignment, rr.org, rr.col, CASE WHEN reg THEN substr(coalesce(s.coding, ''), (3 * r + 1)::BIGINT, 3) ELSE '' END AS codon FROM rr LEFT JOIN coding s ON s.row_id = rr.row_id),
  cd AS (SELECT alignment, org, col, CASE WHEN length(codon) = 3 AND NOT contains(codon, 'N') THEN {SQ.index("codon", 3)} END AS idx FROM cd0),
  ac AS (SELECT alignment, col, string_agg(CASE WHEN idx IS NULL THEN '!' ELSE chr((34 + idx)::INT) END, '' ORDER BY org) AS code FROM cd GROUP BY ALL),
  cc AS (SELECT code, count(*) AS n FROM ac GROUP BY code)"""


@query(_COLUMNS + " SELECT code, n FROM cc")
def codon_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The multiset of codon columns of complete alignments."""
    m = members(spark, sf_dir).where("organism is not null and residues is not null")
    return alignment.codon_columns(alignment.complete(m, len(organism_names(spark, sf_dir)), with_codons))


def organism_names(spark: SparkSession, sf_dir: str) -> list[str]:
    """The leaves of the tree: as many as there are organisms."""
    edges = table(spark, sf_dir, "phylo_edge")
    leaves = edges.join(edges.select(F.col("parent_name").alias("node_name")), "node_name", "left_anti")
    return few(leaves.orderBy("node_name"), "node_name")


_PAIRS = (
    _COLUMNS
    + """, og AS (SELECT node_name AS org, (row_number() OVER (ORDER BY node_name) - 1)::INT AS k FROM phylo_edge WHERE node_name NOT IN (SELECT parent_name FROM phylo_edge WHERE parent_name IS NOT NULL)),
  pc AS (SELECT a.org AS org_a, b.org AS org_b, CASE substr(code, a.k + 1, 1) WHEN '!' THEN 64 ELSE ascii(substr(code, a.k + 1, 1)) - 34 END AS codon_a, CASE substr(code, b.k + 1, 1) WHEN '!' THEN 64 ELSE ascii(substr(code, b.k + 1, 1)) - 34 END AS codon_b, sum(n)::BIGINT AS n
    FROM cc, og a, og b WHERE a.k <> b.k GROUP BY ALL)"""
)


@query(_PAIRS + " SELECT org_a, org_b, codon_a::INT AS codon_a, codon_b::INT AS codon_b, n FROM pc")
def pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11, K17"""
    return alignment.pair_counts(codon_columns(spark, sf_dir), organism_names(spark, sf_dir))


_SUBST = (
    _PAIRS
    + f""", {SQ.GENE.replace(SQ.SEQ + ",", "", 1)},
  bs AS (SELECT doc_id, i, organism, iseq AS x FROM dintron UNION ALL SELECT doc_id, i, organism, {SQ.revcomp("iseq")} FROM dintron),
  bt AS (SELECT organism, unnest(regexp_extract_all(x, '...')) AS codon FROM bs UNION ALL SELECT organism, right(x, 3) FROM bs WHERE length(x) >= 3),
  nul AS (SELECT og.org AS organism, {SQ.index("codon", 3)} AS codon_idx, count(*) AS n FROM bt JOIN og ON bt.organism = 'o' || og.k::VARCHAR WHERE NOT contains(codon, 'N') GROUP BY ALL),
  stops AS (SELECT unnest([idx for idx in range(0, 64) if substr('{S.code_by_index()}', idx + 1, 1) = '*'])::INT AS st),
  cp AS (SELECT * FROM pc WHERE codon_a < 64 AND codon_b < 64 AND codon_a NOT IN (SELECT st FROM stops) AND codon_b NOT IN (SELECT st FROM stops)),
  og2 AS (SELECT DISTINCT org_a, org_b FROM cp),
  f0 AS (SELECT g.org_a, g.org_b, c AS codon_a, coalesce((SELECT sum(n) FROM cp WHERE cp.org_a = g.org_a AND cp.org_b = g.org_b AND cp.codon_a = c), 0) AS n1, coalesce((SELECT n FROM nul WHERE organism = g.org_a AND codon_idx = c), 0) AS n0 FROM (SELECT *, unnest(range(0, 64)) AS c FROM og2) g),
  f1 AS (SELECT *, sum(n1) OVER (PARTITION BY org_a, org_b) AS t1, sum(n0) OVER (PARTITION BY org_a, org_b) AS t0 FROM f0),
  f2 AS (SELECT org_a, org_b, codon_a, {SQ._score("n1", "n0", "t1", "t0")} AS s_from FROM f1),
  g0 AS (SELECT g.org_a, g.org_b, a AS codon_a, b AS codon_b FROM (SELECT *, unnest(range(0, 64)) AS b FROM (SELECT *, unnest(range(0, 64)) AS a FROM og2)) g),
  g1 AS (SELECT g0.*, coalesce(cp.n, 0) AS n1, coalesce(nul.n, 0) AS n0 FROM g0 LEFT JOIN cp ON cp.org_a = g0.org_a AND cp.org_b = g0.org_b AND cp.codon_a = g0.codon_a AND cp.codon_b = g0.codon_b LEFT JOIN nul ON nul.organism = g0.org_b AND nul.codon_idx = g0.codon_b),
  g2 AS (SELECT *, sum(n1) OVER (PARTITION BY org_a, org_b, codon_a) AS t1, sum(n0) OVER (PARTITION BY org_a, org_b, codon_a) AS t0 FROM g1),
  g3 AS (SELECT g2.org_a, g2.org_b, g2.codon_a, g2.codon_b, n1, {SQ._score("n1", "n0", "t1", "t0")} AS s_to, s_from, g2.codon_a IN (SELECT st FROM stops) AS sa, g2.codon_b IN (SELECT st FROM stops) AS sb
    FROM g2 JOIN f2 ON f2.org_a = g2.org_a AND f2.org_b = g2.org_b AND f2.codon_a = g2.codon_a)"""
)


@query(
    _SUBST
    + """, g4 AS (SELECT org_a, org_b, codon_a::INT AS codon_a, codon_b::INT AS codon_b, n1::BIGINT AS n, sa OR sb AS stop,
      (CASE WHEN sa AND sb THEN 0 WHEN sa OR sb THEN -2147483648 WHEN s_to = -2147483648 OR s_from = -2147483648 THEN -2147483648 ELSE least(s_to::BIGINT + s_from, 2147483647) END)::INT AS score FROM g3)
    SELECT org_a, org_b, codon_a, codon_b, n, score, round(sum(CASE WHEN score <> -2147483648 AND NOT stop THEN n::DOUBLE * score ELSE 0 END) OVER w / sum(CASE WHEN stop THEN 0 ELSE n END) OVER w, 4) AS expected
    FROM g4 WINDOW w AS (PARTITION BY org_a, org_b)"""
)
def substitution_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: with the expected score of each pair of organisms, which decides what an anchor is."""
    return _substitutions(spark, sf_dir).select("org_a", "org_b", "codon_a", "codon_b", "n", "score", F.round("expected", 4).alias("expected"))


def _substitutions(spark: SparkSession, sf_dir: str, null_counts: DataFrame | None = None) -> DataFrame:
    names = organism_names(spark, sf_dir)
    null = counting.combined(null_counts or SQ.null_codon_counts(spark, sf_dir))
    of = F.create_map(*(F.lit(x) for k, n in enumerate(names) for x in (f"o{k}", n)))
    # At most 4,096 rows a pair of organisms, which the scores read three times.
    pairs = stored(pair_counts(spark, sf_dir).where("codon_a < 64 and codon_b < 64"), "pairs")
    return scoring.substitution_scores(pairs, null.withColumn("organism", of[F.col("organism")]))


@query(_PAIRS + ", q AS (SELECT * FROM pc WHERE codon_a < 64 AND codon_b < 64) SELECT org_a, org_b, codon_a::INT AS codon_a, codon_b::INT AS codon_b, round((n + 1)::DOUBLE / (sum(n) OVER (PARTITION BY org_a, org_b, codon_a) + 64), 6) AS p FROM q")
def markov_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8"""
    m = scoring.markov(pair_counts(spark, sf_dir).where("codon_a < 64 and codon_b < 64"))
    return m.select("org_a", "org_b", "codon_a", "codon_b", F.round("p", 6).alias("p"))


_GAPS = f"""
  WITH {MEMBER}, pr AS (
    SELECT a.row_id AS row_1, b.row_id AS row_2, a.org AS org_1, b.org AS org_2, a.col, CASE WHEN a.ch = '-' THEN 'I' WHEN b.ch = '-' THEN 'D' ELSE 'M' END AS st
    FROM res a JOIN res b ON a.alignment = b.alignment AND a.seq_idx > b.seq_idx AND a.col = b.col WHERE a.ch <> '-' OR b.ch <> '-'),
  lg AS (SELECT *, CASE WHEN st = lag(st) OVER w THEN 0 ELSE 1 END AS fresh FROM pr WINDOW w AS (PARTITION BY row_1, row_2 ORDER BY col)),
  rn AS (SELECT *, sum(fresh) OVER (PARTITION BY row_1, row_2 ORDER BY col) AS run FROM lg),
  runs AS (SELECT row_1, row_2, run, any_value(org_1) AS org_1, any_value(org_2) AS org_2, any_value(st) AS kind, count(*) AS len FROM rn GROUP BY row_1, row_2, run)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = alignment.sequence_pairs(walked(spark, sf_dir), ["row_id", "organism", "residues", "introns"])
    return evaluated(p, states=alignment.gap_states("residues_1", "residues_2"))


@query(_GAPS + " SELECT org_1, org_2, kind, len::INT AS length, count(*) AS n FROM runs GROUP BY ALL")
def gap_run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of matches, insertions and deletions of all pairs of sequences."""
    p = _pairs(spark, sf_dir).withColumnsRenamed({"organism_1": "org_1", "organism_2": "org_2"})
    return alignment.run_lengths(p, ["org_1", "org_2"])


@query(
    _GAPS
    + """, pos AS (SELECT *, row_number() OVER (PARTITION BY row_1, row_2, run ORDER BY col) AS k, count(*) OVER (PARTITION BY row_1, row_2, run) AS len, lead(st) OVER (PARTITION BY row_1, row_2 ORDER BY col) AS nxt, lead(run) OVER (PARTITION BY row_1, row_2 ORDER BY col) AS nrun FROM rn),
  it AS (SELECT 1 AS side, p.*, i.phase FROM pos p JOIN placed i ON i.row_id = p.row_1 AND i.col = p.col UNION ALL SELECT 2, p.*, i.phase FROM pos p JOIN placed i ON i.row_id = p.row_2 AND i.col = p.col),
  ds AS (SELECT it.org_1, it.org_2, it.side, it.phase, CASE WHEN it.st = 'M' THEN it.k ELSE 0 END AS up,
    CASE WHEN it.st = 'M' THEN it.len - CASE WHEN it.phase = 3 THEN it.k ELSE it.k - 1 END WHEN it.phase < 3 THEN 0 WHEN it.nxt IS NULL THEN NULL WHEN it.nxt = 'M' THEN r.len ELSE 0 END AS down
    FROM it LEFT JOIN runs r ON r.row_1 = it.row_1 AND r.row_2 = it.row_2 AND r.run = it.nrun)
  SELECT org_1, org_2, side, phase, way, d::INT AS distance, count(*) AS n FROM (SELECT org_1, org_2, side, phase, 'up' AS way, up AS d FROM ds UNION ALL SELECT org_1, org_2, side, phase, 'down', down FROM ds WHERE down IS NOT NULL) GROUP BY ALL"""
)
def gap_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of introns to the next gaps."""
    p = _pairs(spark, sf_dir)
    sides = F.array(*(F.struct(F.lit(k).alias("side"), alignment.gap_distances(F.col("states"), F.col(f"introns_{k}")).alias("found")) for k in (1, 2)))
    each = p.select(F.col("organism_1").alias("org_1"), F.col("organism_2").alias("org_2"), F.inline(sides)).select("org_1", "org_2", "side", F.inline("found"))
    ways = F.array(F.struct(F.lit("up").alias("way"), F.col("up").alias("distance")), F.struct(F.lit("down").alias("way"), F.col("down").alias("distance")))
    return each.select("org_1", "org_2", "side", "phase", F.inline(ways)).where("distance is not null").groupBy("org_1", "org_2", "side", "phase", "way", "distance").agg(F.count("*").alias("n"))


@query(
    f"""WITH {MEMBER}, a AS (SELECT m.row_id, m.org, (SELECT count(*) FROM intron i WHERE i.row_id = m.gene_row) AS k FROM wmember m), b AS (SELECT row_id, count(*) FILTER (WHERE phase = 1) AS p1, count(*) FILTER (WHERE phase = 2) AS p2, count(*) FILTER (WHERE phase = 3) AS p3 FROM placed GROUP BY row_id)
  SELECT a.org AS organism, count(*) AS genes, sum(k)::BIGINT AS introns, coalesce(sum(p1), 0)::BIGINT AS phase_1, coalesce(sum(p2), 0)::BIGINT AS phase_2, coalesce(sum(p3), 0)::BIGINT AS phase_3 FROM a LEFT JOIN b ON a.row_id = b.row_id GROUP BY a.org"""
)
def phase_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15"""
    count = lambda k: F.sum(F.size(F.filter("introns", lambda i: i["phase"] == k))).alias(f"phase_{k}")
    return walked(spark, sf_dir).groupBy("organism").agg(F.count("*").alias("genes"), F.sum(F.size("offsets")).alias("introns"), count(1), count(2), count(3))


@query("""
  WITH RECURSIVE t AS (SELECT node_name, parent_name, 0 AS depth, branch_length AS root_distance FROM phylo_edge WHERE parent_name IS NULL
    UNION ALL SELECT e.node_name, e.parent_name, t.depth + 1, coalesce(t.root_distance, 0) + e.branch_length FROM phylo_edge e JOIN t ON e.parent_name = t.node_name)
  SELECT node_name, depth::INT AS depth, round(coalesce(root_distance, 0), 6) AS root_distance, node_name NOT IN (SELECT parent_name FROM phylo_edge WHERE parent_name IS NOT NULL) AS is_leaf FROM t""")
def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree's nodes with depth, distance from the root and whether they are leaves."""
    from exonia.operators.trees import rooted

    return rooted(table(spark, sf_dir, "phylo_edge")).select("node_name", "depth", F.round("root_distance", 6).alias("root_distance"), "is_leaf")


@query(f"""
  WITH {MEMBER}, k AS (SELECT DISTINCT alignment, col, phase, org FROM placed) SELECT alignment, col::INT AS col, phase, count(*)::INT AS organisms, string_agg(org, ',' ORDER BY org) AS names FROM k GROUP BY ALL HAVING count(*) > 1""")
def shared_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Introns of several organisms at one column and phase."""
    at = walked(spark, sf_dir).select("alignment", "organism", F.inline("introns"))
    return at.groupBy("alignment", "col", "phase").agg(F.array_sort(F.collect_set("organism")).alias("o")).where(F.size("o") > 1).select("alignment", "col", "phase", F.size("o").alias("organisms"), F.array_join("o", ",").alias("names"))


@query(f"WITH {MEMBER}, c AS (SELECT row_id, alignment, org, lag(phase, 1, -1) OVER (PARTITION BY row_id ORDER BY col) AS before, phase FROM placed) SELECT org AS organism, before, phase, count(*) AS n FROM c GROUP BY ALL")
def aligned_phase_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3, on the aligned part of genes, as a window."""
    at = walked(spark, sf_dir).select("row_id", "organism", F.inline("introns"))
    return at.withColumn("before", F.lag("phase", 1, -1).over(Window.partitionBy("row_id").orderBy("col"))).groupBy("organism", "before", "phase").agg(F.count("*").alias("n"))
