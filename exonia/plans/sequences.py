"""Queries on sequences. Texts of `documents` stand in for contigs: letters are mapped to nucleotides, and each sequence
carries a gene with an exon in every 90 nucleotides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exonia.functions import seq as S
from exonia.operators import counting, genes, scoring
from exonia.session import spread, table
from exonia.sources import report_lines, text_lines

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: The nucleotides that stand for the letters A to Z.
LETTERS = "ACCGTAGCAGTACGTACGTTACGNTN"
_FROM = "".join(map(chr, [*range(65, 91), *range(97, 123)]))
SPACING = 90


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, seq)"""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text").where(F.col("text").isNotNull()))
    return docs.select("doc_id", F.regexp_replace(F.translate("text", _FROM, LETTERS * 2), "[^ACGTN]", "").alias("seq"))


def carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, organism, chrom, strand, exons, seq)"""
    s = sequences(spark, sf_dir).where(F.length("seq") >= SPACING)
    n = F.expr(f"length(seq) div {SPACING}").cast("int")
    exons = F.transform(F.sequence(F.lit(0), n - 1), lambda i: genes.exon(i * SPACING + 6, i * SPACING + 66 + i % 4))
    return s.select("doc_id", F.concat(F.lit("o"), (F.col("doc_id") % 9).cast("string")).alias("organism"), F.col("doc_id").cast("string").alias("chrom"), F.when(F.col("doc_id") % 2 == 1, "-").otherwise("+").alias("strand"), exons.alias("exons"), F.to_binary("seq", F.lit("utf-8")).alias("seq"))


def revcomp(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


SEQ = f"seq AS (SELECT doc_id, regexp_replace(translate(text, '{_FROM}', '{LETTERS * 2}'), '[^ACGTN]', '', 'g') AS seq FROM documents WHERE text IS NOT NULL)"
GENE = f"""{SEQ},
  dgene AS (SELECT doc_id, 'o' || (doc_id % 9)::VARCHAR AS organism, CASE WHEN doc_id % 2 = 1 THEN '-' ELSE '+' END AS strand, seq, length(seq) // {SPACING} AS k FROM seq WHERE length(seq) >= {SPACING}),
  dexon AS (SELECT doc_id, organism, strand, seq, k, i, {SPACING} * i + 6 AS s, {SPACING} * i + 66 + i % 4 AS e FROM (SELECT *, unnest(range(0, k)) AS i FROM dgene)),
  dcds AS (SELECT doc_id, any_value(organism) AS organism, any_value(strand) AS strand, CASE WHEN any_value(strand) = '-' THEN {revcomp("string_agg(substr(seq, s + 1, e - s), '' ORDER BY i)")} ELSE string_agg(substr(seq, s + 1, e - s), '' ORDER BY i) END AS cds FROM dexon GROUP BY doc_id),
  dintron AS (SELECT doc_id, organism, strand, seq, i, e AS is_, s2 AS ie, CASE WHEN strand = '-' THEN {revcomp("substr(seq, e + 1, s2 - e)")} ELSE substr(seq, e + 1, s2 - e) END AS iseq,
      CASE WHEN strand = '-' THEN s2 - 1 ELSE e END AS d, CASE WHEN strand = '-' THEN e ELSE s2 - 1 END AS a
    FROM (SELECT *, lead(s) OVER (PARTITION BY doc_id ORDER BY i) AS s2 FROM dexon) WHERE s2 IS NOT NULL)"""


def index(x: str, k: int) -> str:
    """SQL: the base-4 index of an unambiguous string of length k."""
    return "(" + " + ".join(f"(instr('AGCT', substr({x}, {i + 1}, 1)) - 1) * {4 ** (k - 1 - i)}" for i in range(k)) + ")::INT"


@query(f"WITH {SEQ} SELECT doc_id, length(seq)::INT AS n_bases, " + ", ".join(f"(length(seq) - length(replace(seq, '{b}', '')))::INT AS n_{b.lower()}" for b in "ACGTN") + " FROM seq")
def base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18, F4"""
    s = sequences(spark, sf_dir)
    return s.select("doc_id", F.length("seq").alias("n_bases"), *(c.alias(n) for n, c in counting.base_counts("seq").items()))


@query(f"WITH {SEQ} SELECT doc_id, md5({revcomp('seq')}) AS reverse_md5, md5(translate(seq, 'AGCT', 'RRYY')) AS ry_md5, md5(substr(seq, 11, 40)) AS slice_md5, md5({revcomp('substr(seq, 11, 40)')}) AS reverse_slice_md5 FROM seq")
def strand_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, F2, F5"""
    s = sequences(spark, sf_dir)
    b = F.to_binary("seq", F.lit("utf-8"))
    end = F.least(F.lit(50), F.greatest(F.length("seq"), F.lit(11)))
    return s.select(
        "doc_id", F.md5(S.reverse_complement("seq")).alias("reverse_md5"), F.md5(S.to_ry("seq")).alias("ry_md5"),
        F.md5(S.dna_slice(b, F.lit(10), end)).alias("slice_md5"), F.md5(S.dna_slice(b, end, F.lit(10))).alias("reverse_slice_md5"),
    )


_CODONS = f"""
  WITH {GENE}, c AS (SELECT doc_id, organism, strand, cds, regexp_extract_all(cds, '...') AS cs FROM dcds),
  u AS (SELECT doc_id, organism, unnest(cs) AS codon, generate_subscripts(cs, 1) AS pos FROM c),
  v AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM u WHERE NOT contains(codon, 'N')),
  coding AS (
    SELECT organism, CASE WHEN r = 1 THEN 'first' ELSE 'middle' END AS class, codon FROM v
    UNION ALL SELECT organism, 'last', right(cds, 3) FROM c WHERE length(cds) >= 3 AND NOT contains(right(cds, 3), 'N')),
  counts AS (SELECT organism, class, {index("codon", 3)} AS codon_idx, count(*) AS n FROM coding GROUP BY ALL),
  both_strands AS (SELECT doc_id, i, 0 AS rev, organism, iseq AS x FROM dintron UNION ALL SELECT doc_id, i, 1, organism, {revcomp("iseq")} FROM dintron),
  nu AS (SELECT doc_id, i, rev, organism, unnest(cs) AS codon, generate_subscripts(cs, 1) AS pos FROM (SELECT *, regexp_extract_all(x, '...') AS cs FROM both_strands)),
  nv AS (SELECT *, row_number() OVER (PARTITION BY doc_id, i, rev ORDER BY pos) AS r FROM nu WHERE NOT contains(codon, 'N')),
  nothing AS (
    SELECT organism, CASE WHEN r = 1 THEN 'first' ELSE 'middle' END AS class, codon FROM nv
    UNION ALL SELECT organism, 'last', right(x, 3) FROM both_strands WHERE length(x) >= 3 AND NOT contains(right(x, 3), 'N')),
  null_counts AS (SELECT organism, class, {index("codon", 3)} AS codon_idx, count(*) AS n FROM nothing GROUP BY ALL)"""


@query(_CODONS + " SELECT organism, class, codon_idx, n FROM counts")
def codon_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3, P6"""
    return counting.codon_counts(carried(spark, sf_dir))


@query(_CODONS + " SELECT organism, class, codon_idx, n FROM null_counts")
def null_codon_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, P7"""
    return counting.null_codon_counts(carried(spark, sf_dir))


@query(_CODONS + ", k AS (SELECT organism, codon_idx, sum(n) AS n FROM counts GROUP BY ALL), m AS (SELECT organism, unnest([codon_idx // 16, codon_idx // 4 % 4, codon_idx % 4]) AS nuc_idx, n FROM k) SELECT organism, nuc_idx::INT AS nuc_idx, sum(n)::BIGINT AS n FROM m GROUP BY ALL")
def nucleotide_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5, A6"""
    return counting.nucleotide_marginals(counting.combined(codon_counts(spark, sf_dir)))


def _score(n1: str, n0: str, t1: str, t0: str) -> str:
    return f"CASE WHEN {n1} = 0 THEN CASE WHEN {n0} = 0 THEN 0 ELSE -2147483648 END WHEN {n0} = 0 THEN 2147483647 ELSE trunc(ln(({n1}::DOUBLE / {t1}) / ({n0}::DOUBLE / {t0})) / {scoring.SCALES['millibans']!r}::DOUBLE)::INT END"


_SCORES = (
    _CODONS
    + f""", k0 AS (SELECT organism, codon_idx, sum(n) AS n FROM null_counts GROUP BY ALL),
  grid AS (SELECT organism, class, unnest(range(0, 64))::INT AS codon_idx FROM (SELECT DISTINCT organism, class FROM counts)),
  sc0 AS (SELECT g.organism, g.class, g.codon_idx, coalesce(c.n, 0) AS n1, coalesce(k0.n, 0) AS n0 FROM grid g
    LEFT JOIN counts c ON c.organism = g.organism AND c.class = g.class AND c.codon_idx = g.codon_idx LEFT JOIN k0 ON k0.organism = g.organism AND k0.codon_idx = g.codon_idx),
  sc1 AS (SELECT *, sum(n1) OVER (PARTITION BY organism, class) AS t1, sum(n0) OVER (PARTITION BY organism, class) AS t0 FROM sc0),
  sc AS (SELECT organism, class, codon_idx, n1, n0, t1, t0, {_score("n1", "n0", "t1", "t0")} AS score FROM sc1)"""
)


@query(_SCORES + " SELECT organism, class, codon_idx, n1::BIGINT AS n1, n0::BIGINT AS n0, score::INT AS score FROM sc")
def codon_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M5, M6"""
    null = counting.combined(null_codon_counts(spark, sf_dir))
    return scoring.score_table(codon_counts(spark, sf_dir), null, ["organism", "class"], "codon_idx", 64, ["organism"])


@query(_SCORES + " SELECT organism, class, CASE WHEN bool_and(n1 = 0 OR n0 > 0) THEN round(sum(CASE WHEN n1 > 0 AND n0 > 0 THEN n1 / t1 * ln((n1 / t1) / (n0 / t0)) END), 6) END AS kl FROM (SELECT organism, class, n1::DOUBLE AS n1, n0::DOUBLE AS n0, t1::DOUBLE AS t1, t0::DOUBLE AS t0 FROM sc) GROUP BY ALL")
def codon_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3"""
    return scoring.divergence(codon_scores(spark, sf_dir), ["organism", "class"]).withColumn("kl", F.round("kl", 6))


def _site(donor: bool) -> str:
    """SQL: (organism, doc_id, i, motif, edge) of donor or acceptor sites; null where they don't fit."""
    m, b = counting.DONOR_SIZE if donor else counting.ACCEPTOR_SIZE
    at, fw = ("d", "strand <> '-'") if donor else ("a", "strand = '-'")

    def part(pos: str, n: int) -> str:
        lo = f"CASE WHEN {fw} THEN {pos} ELSE {pos} - {n} + 1 END"
        piece = f"substr(seq, {lo} + 1, {n})"
        return f"CASE WHEN {lo} >= 0 AND {lo} + {n} <= length(seq) THEN CASE WHEN {fw} THEN {piece} ELSE {revcomp(piece)} END END"

    step = f"CASE WHEN {fw} THEN {m} ELSE -{m} END"
    return f"SELECT organism, doc_id, i, {part(at, m)} AS motif, {part(f'({at} + {step})', b)} AS edge FROM dintron"


def _motif_sql(site: str, m: int) -> str:
    return f"SELECT organism, CASE WHEN motif IS NULL OR contains(motif, 'N') THEN -1 ELSE {index('motif', m)} END AS motif_idx, count(*) AS n FROM {site} GROUP BY ALL"


def _edge_sql(site: str, b: int) -> str:
    return f"SELECT organism, place::INT AS place, (instr('AGCT', c) - 1)::INT AS nuc_idx, count(*) AS n FROM (SELECT organism, place, substr(edge, place + 1, 1) AS c FROM (SELECT organism, edge, unnest(range(0, {b})) AS place FROM {site} WHERE edge IS NOT NULL)) WHERE c <> 'N' GROUP BY ALL"


def _null_sql(donor: bool) -> str:
    m, b = counting.DONOR_SIZE if donor else counting.ACCEPTOR_SIZE
    s = "cds" if donor else revcomp("cds")
    return f"SELECT organism, left(w, {m}) AS motif, right(w, {b}) AS edge FROM (SELECT organism, substr(x, p, {m + b}) AS w FROM (SELECT organism, x, unnest(range(1, length(x) - {m + b} + 1)) AS p FROM (SELECT organism, {s} AS x FROM dcds)))"


_SITES = f"WITH {GENE}, site5 AS ({_site(True)}), site3 AS ({_site(False)})"


@query(_SITES + f" SELECT 'donor' AS site, * FROM ({_motif_sql('site5', 4)}) UNION ALL SELECT 'acceptor', * FROM ({_motif_sql('site3', 3)})")
def motif_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7, F9, M11"""
    g = carried(spark, sf_dir)
    side = lambda donor: counting.motif_counts(counting.site_texts(g, donor)).select(F.lit("donor" if donor else "acceptor").alias("site"), "organism", "motif_idx", "n")
    return side(True).unionByName(side(False))


@query(_SITES + f" SELECT 'donor' AS site, * FROM ({_edge_sql('site5', 2)}) UNION ALL SELECT 'acceptor', * FROM ({_edge_sql('site3', 15)})")
def boundary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8"""
    g = carried(spark, sf_dir)
    side = lambda donor: counting.edge_counts(counting.site_texts(g, donor)).select(F.lit("donor" if donor else "acceptor").alias("site"), "organism", "place", "nuc_idx", "n")
    return side(True).unionByName(side(False))


@query(f"WITH {GENE}, n5 AS ({_null_sql(True)}), n3 AS ({_null_sql(False)}) SELECT 'donor' AS site, * FROM ({_motif_sql('n5', 4)}) UNION ALL SELECT 'acceptor', * FROM ({_motif_sql('n3', 3)})")
def null_motif_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9"""
    g = carried(spark, sf_dir)
    side = lambda donor: counting.null_motif_counts(g, donor).select(F.lit("donor" if donor else "acceptor").alias("site"), "organism", "motif_idx", "n")
    return side(True).unionByName(side(False))


def _site_tables_sql(donor: bool) -> str:
    """SQL: counts and scores of donors or acceptors: et with mscore, mt with escore; m1 has the ambiguous motifs too."""
    m, b = counting.DONOR_SIZE if donor else counting.ACCEPTOR_SIZE
    return f"""WITH {GENE}, s5 AS ({_site(donor)}), n5 AS ({_null_sql(donor)}), m1 AS ({_motif_sql("s5", m)}), m0 AS ({_motif_sql("n5", m)}), e1 AS ({_edge_sql("s5", b)}), e0 AS ({_edge_sql("n5", b)}),
  mg AS (SELECT organism, unnest(range(0, {4**m}))::INT AS idx FROM (SELECT DISTINCT organism FROM m1 WHERE motif_idx >= 0)),
  ms AS (SELECT mg.organism, idx, coalesce(m1.n, 0) AS n1, coalesce(m0.n, 0) AS n0 FROM mg LEFT JOIN m1 ON m1.organism = mg.organism AND m1.motif_idx = idx LEFT JOIN m0 ON m0.organism = mg.organism AND m0.motif_idx = idx),
  mt AS (SELECT *, sum(n1) OVER (PARTITION BY organism) AS t1, sum(n0) OVER (PARTITION BY organism) AS t0 FROM ms),
  mscore AS (SELECT organism, idx, {_score("n1", "n0", "t1", "t0")} AS sc FROM mt),
  eg AS (SELECT organism, place, unnest(range(0, 4))::INT AS idx FROM (SELECT DISTINCT organism, place FROM e1)),
  es AS (SELECT eg.organism, eg.place, idx, coalesce(e1.n, 0) AS n1, coalesce(e0.n, 0) AS n0 FROM eg LEFT JOIN e1 ON e1.organism = eg.organism AND e1.place = eg.place AND e1.nuc_idx = idx LEFT JOIN e0 ON e0.organism = eg.organism AND e0.place = eg.place AND e0.nuc_idx = idx),
  et AS (SELECT *, sum(n1) OVER (PARTITION BY organism, place) AS t1, sum(n0) OVER (PARTITION BY organism, place) AS t0 FROM es),
  escore AS (SELECT organism, place, idx, {_score("n1", "n0", "t1", "t0")} AS sc FROM et)"""


def _site_score_sql(donor: bool) -> str:
    """SQL: (doc_id, site_no, score) of every donor or acceptor under its organism's model."""
    m, b = counting.DONOR_SIZE if donor else counting.ACCEPTOR_SIZE
    never = -2147483648
    return f"""{_site_tables_sql(donor)},
  placed AS (SELECT doc_id, i, organism, edge, unnest(range(0, {b})) AS place FROM s5),
  bs AS (SELECT p.doc_id, p.i, sum(e.sc)::BIGINT AS total, bool_or(e.sc IS NULL OR e.sc = {never}) AS bad FROM placed p LEFT JOIN escore e ON e.organism = p.organism AND e.place = p.place AND e.idx = instr('AGCT', substr(p.edge, p.place + 1, 1)) - 1 GROUP BY ALL)
  SELECT s.doc_id, s.i::INT AS site_no, CASE WHEN m.sc IS NULL OR m.sc = {never} OR bs.bad THEN {never} ELSE least(m.sc::BIGINT + bs.total, 2147483647) END::INT AS score
  FROM s5 s JOIN bs ON bs.doc_id = s.doc_id AND bs.i = s.i LEFT JOIN mscore m ON m.organism = s.organism AND NOT contains(s.motif, 'N') AND m.idx = {index("s.motif", m)}"""


def site_tables(g: DataFrame, donor: bool) -> tuple[DataFrame, DataFrame]:
    """The score tables of motifs and of boundaries."""
    texts = counting.site_texts(g, donor)
    m = (counting.DONOR_SIZE if donor else counting.ACCEPTOR_SIZE)[0]
    motifs = scoring.score_table(counting.motif_counts(texts).where("motif_idx >= 0"), counting.null_motif_counts(g, donor), ["organism"], "motif_idx", 4**m)
    return motifs, scoring.score_table(counting.edge_counts(texts), counting.null_edge_counts(g, donor), ["organism", "place"], "nuc_idx", 4)


def _scored_sites(spark: SparkSession, sf_dir: str, donor: bool) -> DataFrame:
    g = carried(spark, sf_dir)
    m, b = counting.DONOR_SIZE if donor else counting.ACCEPTOR_SIZE
    motifs, edges = site_tables(g, donor)
    at = F.transform(genes.introns(F.col("exons"), F.col("strand")), lambda i: i["donor_pos" if donor else "acceptor_pos"])
    # Acceptors are read on the other strand; sites are numbered along the contig.
    rows = g.select("doc_id", "organism", "seq", genes.is_reverse().alias("_rev"), (genes.is_reverse() != F.lit(donor)).alias("_fw"), F.posexplode(at).alias("_k", "_at"), F.size("exons").alias("_n"))
    sites = rows.select(
        "doc_id", "organism", F.when(F.col("_rev"), F.col("_n") - 2 - F.col("_k")).otherwise(F.col("_k")).alias("site_no"),
        counting.read_from(F.col("seq"), F.col("_at"), m, F.col("_fw")).alias("motif"),
        counting.read_from(F.col("seq"), F.col("_at") + F.when(F.col("_fw"), m).otherwise(-m), b, F.col("_fw")).alias("edge"),
    )
    return scoring.site_scores(sites, motifs, edges).select("doc_id", "site_no", "score")


@query(_site_score_sql(True))
def donor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: every donor site under its organism's model."""
    return _scored_sites(spark, sf_dir, True)


@query(_site_score_sql(False))
def acceptor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: every acceptor site under its organism's model."""
    return _scored_sites(spark, sf_dir, False)


@query(
    f"WITH {GENE}, i2 AS (SELECT organism, left(iseq, 2) AS d, right(iseq, 2) AS a FROM dintron) "
    + "SELECT organism, CASE d WHEN 'GT' THEN 1199 WHEN 'GC' THEN -1092 WHEN 'AT' THEN -1092 ELSE -2147483648 END AS donor_score, CASE a WHEN 'AG' THEN 1195 WHEN 'AC' THEN -795 WHEN 'TG' THEN -795 ELSE -2147483648 END AS acceptor_score, count(*) AS n FROM i2 GROUP BY ALL"
)
def generic_site_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M10"""
    g = carried(spark, sf_dir)
    i = g.select("organism", F.explode(genes.intron_sequences(F.col("seq"), F.col("exons"), F.col("strand"))).alias("s"))
    sites = i.select("organism", F.left("s", F.lit(2)).alias("d"), F.right("s", F.lit(2)).alias("a")).groupBy("organism", "d", "a").agg(F.count("*").alias("n"))
    return sites.groupBy("organism", scoring.generic_score(F.col("d"), "donor").alias("donor_score"), scoring.generic_score(F.col("a"), "acceptor").alias("acceptor_score")).agg(F.sum("n").alias("n"))


@query(
    f"WITH {GENE}, c AS (SELECT doc_id, regexp_extract_all(cds, '...') AS cs FROM dcds) SELECT doc_id, coalesce(array_to_string(list_transform(cs, lambda x: CASE WHEN contains(x, 'N') THEN 'X' ELSE substr('{S.code_by_index()}', {index('x', 3)} + 1, 1) END), ''), '') AS protein FROM c"
)
def translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole codons translated, ambiguous ones as X."""
    coding = genes.cds(F.col("seq"), F.col("exons"), F.col("strand"))
    return carried(spark, sf_dir).select("doc_id", F.array_join(F.transform(counting.triplets(coding), lambda c: F.coalesce(S.residue_of(S.codon_index(c)), F.lit("X"))), "").alias("protein"))


@query(f"WITH {SEQ} SELECT doc_id, '>' || doc_id::VARCHAR || ' /length=' || length(seq)::VARCHAR || chr(10) || rtrim(regexp_replace(seq, '(.{{50}})', '\\1' || chr(10), 'g'), chr(10)) AS fasta FROM seq")
def fasta_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4"""
    s = sequences(spark, sf_dir)
    return s.select("doc_id", text_lines.fasta(F.concat(F.col("doc_id").cast("string"), F.lit(" /length="), F.length("seq").cast("string")), F.col("seq")).alias("fasta"))


@query(f"WITH {SEQ}, w AS (SELECT substr(seq, p, 5) AS w FROM (SELECT seq, unnest(range(1, length(seq) - 3)) AS p FROM seq)) SELECT {index('w', 5)} AS kmer_idx, {index(revcomp('w'), 5)} AS reverse_idx, count(*) AS n FROM w WHERE NOT contains(w, 'N') GROUP BY ALL")
def kmer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4"""
    return counting.kmer_counts(sequences(spark, sf_dir), "seq", 5).select(F.col("kmer_idx").cast("int").alias("kmer_idx"), F.col("reverse_idx").cast("int").alias("reverse_idx"), "n")


@query(
    f"""WITH {GENE}, r AS (SELECT doc_id, any_value(organism) AS organism, any_value(strand) AS strand, any_value(seq) AS seq, greatest(min(s) - 100, 0) AS lo, least(max(e) + 100, length(any_value(seq))) AS hi FROM dexon GROUP BY doc_id)
  SELECT doc_id, '/region=' || lo::VARCHAR || '..' || hi::VARCHAR || ' /strand=' || strand || ' /organism=' || organism AS tags, md5(CASE WHEN strand = '-' THEN {revcomp("substr(seq, lo + 1, hi - lo)")} ELSE substr(seq, lo + 1, hi - lo) END) AS context_md5 FROM r"""
)
def genomic_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each gene with 100 nucleotides on both sides, cut off at the contig's ends, read block by block."""
    g = carried(spark, sf_dir)
    lo = F.greatest(F.get("exons", 0)["start"] - 100, F.lit(0))
    hi = F.least(F.element_at("exons", -1)["end"] + 100, F.length("seq"))
    ranges = g.select("doc_id", "organism", "chrom", "strand", lo.alias("start"), hi.alias("end"))
    got = counting.slices(ranges, counting.sequence_blocks(g), ["doc_id", "strand"])
    tags = F.format_string("/region=%d..%d /strand=%s /organism=%s", "start", "end", "strand", "organism")
    return got.select("doc_id", tags.alias("tags"), F.md5(F.when(F.col("strand") == "-", S.reverse_complement("text")).otherwise(F.col("text"))).alias("context_md5"))


@query(_CODONS + ", p AS (SELECT a.codon_idx AS a, b.codon_idx AS b, xor(a.codon_idx, b.codon_idx) AS x FROM (SELECT DISTINCT codon_idx FROM counts) a, (SELECT DISTINCT codon_idx FROM counts) b) SELECT a AS codon_a, b AS codon_b, ((x & 3 <> 0)::INT + ((x >> 2) & 3 <> 0)::INT + (x >> 4 <> 0)::INT)::INT AS distance FROM p")
def codon_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """of all codons that occur, at most 64, each with each."""
    seen = codon_counts(spark, sf_dir).select("codon_idx").distinct()
    all_codons = seen.withColumn("codon_b", F.explode(F.sequence(F.lit(0), F.lit(63)))).withColumnRenamed("codon_idx", "codon_a")
    pairs = all_codons.join(seen.withColumnRenamed("codon_idx", "codon_b"), "codon_b", "left_semi")
    return pairs.select("codon_a", "codon_b", S.codon_distance(F.col("codon_a"), F.col("codon_b")).alias("distance"))


@query(_CODONS + f""", g AS (SELECT organism, codon_idx, sum(CASE WHEN class = 'first' THEN n ELSE 0 END)::BIGINT AS a, sum(CASE WHEN class = 'middle' THEN n ELSE 0 END)::BIGINT AS b, sum(CASE WHEN class = 'last' THEN n ELSE 0 END)::BIGINT AS c FROM counts GROUP BY ALL)
  SELECT organism, concat_ws(chr(9), substr('AGCT', codon_idx // 16 + 1, 1) || substr('AGCT', codon_idx // 4 % 4 + 1, 1) || substr('AGCT', codon_idx % 4 + 1, 1) || '/' || substr('{S.code_by_index()}', codon_idx + 1, 1), a::VARCHAR, b::VARCHAR, c::VARCHAR) AS value FROM g""")
def codon_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K12"""
    return report_lines.codon_lines(codon_counts(spark, sf_dir))


@query(f"WITH {GENE} SELECT doc_id, i::INT AS nth, lower(iseq) AS text FROM dintron")
def intron_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Introns; those here are too short for anything to be left out."""
    i = carried(spark, sf_dir).select("doc_id", F.posexplode(genes.intron_sequences(F.col("seq"), F.col("exons"), F.col("strand"))).alias("nth", "s"))
    return i.select("doc_id", "nth", report_lines.elided(F.col("s")).alias("text"))


@query(_SCORES + " SELECT organism, class, codon_idx, round(ln(((n1 + 1)::DOUBLE / (t1 + 64)) / ((n0 + 1)::DOUBLE / (t0 + 64))), 6) AS ratio, round(ln(n1 + 1 + n0 + 2), 6) AS log_sum FROM sc")
def laplace_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2, M4"""
    from pyspark.sql import Window

    per = Window.partitionBy("organism", "class")
    n1, n0 = F.col("n1"), F.col("n0")
    return codon_scores(spark, sf_dir).select(
        "organism", "class", "codon_idx", F.round(scoring.laplace_ratio(n1, n0, F.sum("n1").over(per), F.sum("n0").over(per), 64), 6).alias("ratio"), F.round(scoring.log_add(F.ln(n1 + 1), F.ln(n0 + 2)), 6).alias("log_sum")
    )
