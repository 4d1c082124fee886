"""Queries that give reports as lines of text, each line with the keys it is sorted by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exonia.functions import seq as S
from exonia.operators import alignment, counting, genes, scoring
from exonia.plans import alignments as AL
from exonia.plans import history as HI
from exonia.plans import models as MD
from exonia.plans import sequences as SQ
from exonia.plans.views import INTRON, models
from exonia.session import evaluated, table
from exonia.sources import report_lines, text_lines

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def _decimal(n: str, total: str, places: int = 0) -> str:
    """SQL: n / total as text with so many places, in whole numbers."""
    one = 10**places
    scaled = f"((2 * {one} * ({n})::BIGINT + ({total})::BIGINT) // (2 * ({total})::BIGINT))"
    text = f"{scaled}::VARCHAR" if places == 0 else f"({scaled} // {one})::VARCHAR || '.' || lpad(({scaled} % {one})::VARCHAR, {places}, '0')"
    return f"CASE WHEN ({total}) > 0 THEN {text} ELSE '-' END"


def _lines(*cells: str) -> str:
    return f"concat_ws(chr(9), {', '.join(cells)})"


def _codon(i: str) -> str:
    return f"(substr('AGCT', ({i}) // 16 + 1, 1) || substr('AGCT', ({i}) // 4 % 4 + 1, 1) || substr('AGCT', ({i}) % 4 + 1, 1) || '/' || substr('{S.code_by_index()}', ({i}) + 1, 1))"


def _motif(i: str, k: int) -> str:
    return "(" + " || ".join(f"substr('AGCT', ({i}) // {4 ** (k - 1 - j)} % 4 + 1, 1)" for j in range(k)) + ")"


def _classes(cell: str) -> str:
    return ", ".join(f"coalesce(max({cell}) FILTER (class = '{c}'), '-')" for c in report_lines.CLASSES)


MILLIBANS = f"{scoring.SCALES['millibans']!r}::DOUBLE"


def _kl(source: str, keys: str) -> str:
    """SQL: the divergence in nats of n1 from n0, rows with their totals t1 and t0."""
    return f"SELECT {keys}, CASE WHEN bool_and(n1 = 0 OR n0 > 0) THEN sum(CASE WHEN n1 > 0 AND n0 > 0 THEN n1::DOUBLE / t1::DOUBLE * ln((n1::DOUBLE / t1::DOUBLE) / (n0::DOUBLE / t0::DOUBLE)) END) END AS kl FROM {source} GROUP BY ALL"


_FREQUENCIES = SQ._SCORES.replace("k0 AS (SELECT organism, codon_idx, sum(n) AS n FROM null_counts GROUP BY ALL)", "k0 AS (SELECT organism, codon_idx, n FROM null_counts WHERE class = 'middle')")


@query(f"""{_FREQUENCIES}, kl AS ({_kl("sc", "organism, class")})
  SELECT organism, codon_idx, {_lines(_codon("codon_idx"), _classes("n1::VARCHAR"), "max(n0)::VARCHAR", _classes(_decimal("100 * n1", "t1", 2) + " || '%'"), "max(" + _decimal("100 * n0", "t0", 2) + " || '%')", _classes("score::VARCHAR"))} AS value FROM sc GROUP BY organism, codon_idx
  UNION ALL SELECT organism, 64, {_lines("'#expected'", _classes(f"printf('%.3f', kl / {MILLIBANS})"))} FROM kl GROUP BY organism""")
def codon_frequency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codons in coding sequence and, as the middle ones of introns, under the null model."""
    g = SQ.carried(spark, sf_dir)
    null = counting.null_codon_counts(g).where("class = 'middle'").drop("class")
    return report_lines.codon_frequency_lines(scoring.score_table(counting.codon_counts(g), null, ["organism", "class"], "codon_idx", 64, ["organism"]))


@query(f"{SQ._SCORES} SELECT organism, codon_idx, {_lines(repr('#CODON'), _codon('codon_idx'), _classes('score::VARCHAR'))} AS value FROM sc GROUP BY organism, codon_idx")
def codon_score_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K12"""
    return report_lines.codon_score_lines(SQ.codon_scores(spark, sf_dir))


def _site_sql(donor: bool) -> str:
    m, b = counting.DONOR_SIZE if donor else counting.ACCEPTOR_SIZE
    motif = _motif("idx", m)
    read = motif if donor else SQ.revcomp(motif)
    shown = f"'#SSC motif [' || {motif}" if donor else f"'#SSC motif ' || {read} || ']'"
    side, sign = ("5''", "++") if donor else ("3''", "--")
    letters = S.NUCLEOTIDES if donor else S.NUCLEOTIDES.translate(str.maketrans("ACGT", "TGCA"))
    by = "chr(9) ORDER BY idx"
    shares = _decimal("n1", "t1", 3)
    return f"""{SQ._site_tables_sql(donor)}, mk AS ({_kl("mt", "organism")}), ek AS ({_kl("et", "organism, place")}),
  total AS (SELECT organism, CASE WHEN count(*) = count(kl) THEN sum(kl) / {MILLIBANS} END AS kl FROM (SELECT organism, kl FROM mk UNION ALL SELECT organism, kl FROM ek) GROUP BY organism)
  SELECT organism, 'motif' AS part, idx::INT AS at, {_lines(shown, "n1::VARCHAR")} AS value FROM mt WHERE n1 > 0
  UNION ALL SELECT organism, 'motif', -1, {_lines("'#SSC motif null'", "n::VARCHAR")} FROM m1 WHERE motif_idx < 0
  UNION ALL SELECT organism, 'boundary', place::INT, {_lines(f"'#SSC bndry ' || ({'' if donor else '-'}(place + {m}))::VARCHAR", f"string_agg(substr('{letters}', idx + 1, 1) || ' ' || n1::VARCHAR, {by})", f"string_agg({shares}, {by})")} FROM et GROUP BY organism, place
  UNION ALL SELECT organism, 'motif score', idx, {_lines(f"'#SPLICE {side}mot ' || {read}", "n1::VARCHAR", "sc::VARCHAR")} FROM mt JOIN mscore USING (organism, idx) WHERE n1 > 0
  UNION ALL SELECT organism, 'motif score', -1, {_lines(f"'#SPLICE {side}mot KL'", "coalesce(printf('%.4f', kl), '-')")} FROM mk
  UNION ALL SELECT organism, 'boundary score', place::INT, {_lines(f"'#SPLICE {side}{sign}' || place::VARCHAR", f"string_agg(substr('{S.NUCLEOTIDES}', idx + 1, 1) || ' ' || n1::VARCHAR || '/' || sc::VARCHAR, {by})", "'KL ' || coalesce(printf('%.4f', any_value(kl)), '-')")} FROM et JOIN escore USING (organism, place, idx) JOIN ek USING (organism, place) GROUP BY organism, place
  UNION ALL SELECT organism, 'total', 0, {_lines(f"'#SPLICE {side}KLmbans'", "coalesce(printf('%.3f', kl), '-')")} FROM total"""


def _site_report(spark: SparkSession, sf_dir: str, donor: bool) -> DataFrame:
    g = SQ.carried(spark, sf_dir)
    unread = counting.motif_counts(counting.site_texts(g, donor)).where("motif_idx < 0").select("organism", "n")
    return report_lines.site_lines(*SQ.site_tables(g, donor), unread, donor, (counting.DONOR_SIZE if donor else counting.ACCEPTOR_SIZE)[0])


@query(_site_sql(True))
def donor_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """donors' motifs and boundaries, counts, shares, scores and divergences."""
    return _site_report(spark, sf_dir, True)


@query(_site_sql(False))
def acceptor_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of acceptors."""
    return _site_report(spark, sf_dir, False)


@query(f"""{AL._SUBST}, g4 AS (SELECT org_a, org_b, codon_a::INT AS codon_a, codon_b, n1, s_from, sa OR sb AS stop,
      (CASE WHEN sa AND sb THEN 0 WHEN sa OR sb THEN -2147483648 WHEN s_to = -2147483648 OR s_from = -2147483648 THEN -2147483648 ELSE least(s_to::BIGINT + s_from, 2147483647) END)::INT AS score FROM g3)
  SELECT org_a, org_b, codon_a, {_lines(_codon("codon_a"), "any_value(s_from)::VARCHAR", "string_agg(score::VARCHAR, chr(9) ORDER BY codon_b)")} AS value FROM g4 GROUP BY org_a, org_b, codon_a
  UNION ALL SELECT org_a, org_b, 64, {_lines("'#expected'", "printf('%.3f', sum(CASE WHEN score <> -2147483648 AND NOT stop THEN n1::DOUBLE * score ELSE 0 END) / sum(CASE WHEN stop THEN 0 ELSE n1 END))")} FROM g4 GROUP BY org_a, org_b""")
def substitution_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The substitution scores of each pair of organisms as a table."""
    return report_lines.substitution_lines(AL._substitutions(spark, sf_dir))


_PHASES = ", ".join(f"'ph{p} ' || coalesce(p{p}, 0)::VARCHAR || '=' || {_decimal(f'100 * coalesce(p{p}, 0)', 'introns')} || '%'" for p in (1, 2, 0))
_FOLLOWING = ", ".join(f"'t{p} ' || t{p}::VARCHAR || ' (' || {_decimal(f'100 * t{p}', 't')} || '%)'" for p in range(3))
_COUNT = ", ".join(f"(count(*) FILTER (phase = {p}))::BIGINT AS {{}}{p}" for p in range(3))


@query(f"""{MD._HISTOGRAM}, p AS (SELECT organism, cds_offset % 3 AS phase, lag(cds_offset % 3, 1, -1) OVER (PARTITION BY row_id ORDER BY iidx) AS before FROM intron),
  ph AS (SELECT organism, {_COUNT.format("p", "p", "p")} FROM p GROUP BY organism), tr AS (SELECT organism, before, count(*) AS t, {_COUNT.format("t", "t", "t")} FROM p GROUP BY organism, before),
  s AS (SELECT organism, coalesce(sum(n) FILTER (kind = 'exon_count'), 0)::BIGINT AS genes, coalesce(sum(n) FILTER (kind = 'intron_length'), 0)::BIGINT AS introns, coalesce(sum(n * value) FILTER (kind = 'intron_length'), 0)::BIGINT AS bases,
    coalesce(sum(n) FILTER (kind = 'exon_length'), 0)::BIGINT AS exons, coalesce(sum(n * value) FILTER (kind = 'exon_length'), 0)::BIGINT AS coding, arg_max(value, n * 1000000000 - value) FILTER (kind = 'intron_length') AS typical FROM h GROUP BY organism)
  SELECT organism, 'tally' AS part, {_lines("'#TALLY'", "organism", "'ngenes ' || genes::VARCHAR", "'nintrons ' || introns::VARCHAR", f"concat_ws(', ', {_PHASES})", "'intr/gene ' || " + _decimal("introns", "genes", 3), "'tot_intron_len ' || bases::VARCHAR", "'avg_ilen ' || " + _decimal("bases", "introns", 3),
    "'typical ' || coalesce(typical::VARCHAR, '-')", "'tot_exon_len ' || " + _decimal("coding", "3", 3), "'nexons ' || exons::VARCHAR", "'avg_elen ' || " + _decimal("coding", "3 * exons", 3))} AS value FROM s LEFT JOIN ph USING (organism)
  UNION ALL SELECT organism, before::VARCHAR, {_lines("'#TRANSITION'", "organism", "before::VARCHAR", _FOLLOWING)} FROM tr""")
def length_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each organism the numbers and mean lengths of exons and introns, and percentages of phases and transitions."""
    own = models(spark, sf_dir)
    return report_lines.length_lines(genes.length_histograms(own), genes.phase_transitions(own))


_DISTANCES = AL.ORACLE["gap_distances"].rsplit("SELECT org_1, org_2, side, phase, way", 1)[0]
_AT = "side::VARCHAR || '.ph' || phase::VARCHAR"


@query(f"""{_DISTANCES}, c AS (
    SELECT org_1 || '/' || org_2 AS pair, CASE kind WHEN 'I' THEN 3 WHEN 'D' THEN 4 ELSE 5 END AS part, NULL::INT AS side, NULL::INT AS phase, len AS length, count(*) AS n FROM runs GROUP BY ALL
    UNION ALL SELECT org_1 || '/' || org_2, way, side, phase, d, count(*) FROM (SELECT org_1, org_2, side, phase, 6 AS way, up AS d FROM ds UNION ALL SELECT org_1, org_2, side, phase, 7, down FROM ds WHERE down IS NOT NULL) GROUP BY ALL),
  ct AS (SELECT * FROM c UNION ALL SELECT pair, part, side, phase, NULL, sum(n)::BIGINT FROM c GROUP BY pair, part, side, phase),
  ta AS (SELECT m.row_id, m.org, (SELECT count(*) FROM intron i WHERE i.row_id = m.gene_row) AS k FROM wmember m),
  tb AS (SELECT row_id, {", ".join(f"count(*) FILTER (phase = {p}) AS p{p}" for p in (1, 2, 3))} FROM placed GROUP BY row_id),
  tt AS (SELECT ta.org, count(*) AS genes, sum(k)::BIGINT AS al, {", ".join(f"coalesce(sum(p{p}), 0)::BIGINT AS p{p}" for p in (1, 2, 3))} FROM ta LEFT JOIN tb ON ta.row_id = tb.row_id GROUP BY ta.org)
  SELECT pair, part::INT AS part, side::INT AS side, phase::INT AS phase, length::INT AS length, {_lines("['#INSERT', '#DELETE', '#MATCH', '#UP', '#DOWN'][part - 2]", "pair", _AT, "coalesce(length::VARCHAR, 'total')", "n::VARCHAR")} AS value FROM ct
  UNION ALL SELECT DISTINCT a.org || '/' || b.org, 2, NULL, NULL, NULL, {_lines("'#STATISTICS'", "a.org || '/' || b.org")} FROM wmember a JOIN wmember b ON a.alignment = b.alignment AND a.seq_idx > b.seq_idx
  UNION ALL SELECT org, 1, NULL, NULL, NULL, {_lines("'#TALLY'", "org", "p1::VARCHAR", "p2::VARCHAR", "p3::VARCHAR", "(p1 + p2 + p3)::VARCHAR", "'// ngenes ' || genes::VARCHAR || ', totintr ' || al::VARCHAR || ', avgpergene ' || " + _decimal("al", "genes", 3))} FROM tt""")
def gap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases of each organism, runs and distances to gaps of each pair of organisms, with totals."""
    return report_lines.gap_lines(AL.walked(spark, sf_dir))


@query(f"""WITH {SQ.GENE}, x AS (SELECT *, CASE WHEN strand = '-' THEN -i ELSE i END AS o, sum(e - s) OVER (PARTITION BY doc_id ORDER BY CASE WHEN strand = '-' THEN -i ELSE i END) AS upto, lead(s) OVER (PARTITION BY doc_id ORDER BY i) AS above, lag(e) OVER (PARTITION BY doc_id ORDER BY i) AS below FROM dexon),
  y AS (SELECT *, CASE WHEN strand = '-' THEN s - below ELSE above - e END AS gap FROM x),
  t AS (SELECT doc_id, coalesce(string_agg(upto::VARCHAR, ',' ORDER BY o) FILTER (gap IS NOT NULL), '00') AS offsets, coalesce(string_agg(gap::VARCHAR, ',' ORDER BY o) FILTER (gap IS NOT NULL), '00') AS gaps FROM y GROUP BY doc_id),
  c AS (SELECT doc_id, regexp_extract_all(cds, '...') AS cs FROM dcds),
  p AS (SELECT doc_id, coalesce(array_to_string(list_transform(cs, lambda x: CASE WHEN contains(x, 'N') THEN 'X' ELSE substr('{S.code_by_index()}', {SQ.index('x', 3)} + 1, 1) END), ''), '') AS protein FROM c)
  SELECT doc_id, md5('>' || doc_id::VARCHAR || ' {{i ' || offsets || ' i}} /intron-length=' || gaps || chr(10) || rtrim(regexp_replace(protein, '(.{{50}})', '\\1' || chr(10), 'g'), chr(10))) AS record_md5 FROM p JOIN t USING (doc_id)""")
def protein_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translated genes as FASTA records whose deflines tell the introns' offsets and lengths."""
    ex, st = F.col("exons"), F.col("strand")
    g = evaluated(SQ.carried(spark, sf_dir), coding=genes.cds(F.col("seq"), ex, st), tags=text_lines.intron_tags(ex, st))
    protein = F.array_join(F.transform(counting.triplets(F.col("coding")), lambda c: F.coalesce(S.residue_of(S.codon_index(c)), F.lit("X"))), "")
    return g.select("doc_id", F.md5(text_lines.fasta(F.concat(F.col("doc_id").cast("string"), F.lit(" "), F.col("tags")), protein)).alias("record_md5"))


@query(f"""WITH {SQ.GENE}, x AS (SELECT doc_id, strand, seq, i, s, e, lead(s) OVER (PARTITION BY doc_id ORDER BY i) AS above, lag(e) OVER (PARTITION BY doc_id ORDER BY i) AS below FROM dexon),
  y AS (SELECT doc_id, i, CASE WHEN strand = '-' THEN {SQ.revcomp("substr(seq, s + 1, 1)")} || {SQ.revcomp("substr(seq, below - 1, 2)")} ELSE substr(seq, e, 1) || substr(seq, above + 1, 2) END AS over FROM x WHERE CASE WHEN strand = '-' THEN below ELSE above END IS NOT NULL)
  SELECT doc_id, i::INT AS exon, CASE WHEN contains(over, 'N') THEN NULL ELSE over END AS codon FROM y""")
def codons_over_introns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codon that begins at the last base of each exon and goes on behind the intron."""
    ex, st = F.col("exons"), F.col("strand")
    g = evaluated(SQ.carried(spark, sf_dir), coding=genes.cds(F.col("seq"), ex, st), reverse=genes.is_reverse())
    # Of the exon that comes last in transcription order there is nothing behind.
    at = F.transform(ex, lambda e, i: F.struct(i.alias("exon"), F.when(F.col("reverse"), e["start"]).otherwise(e["end"] - 1).alias("position")))
    inner = F.slice(at, F.when(F.col("reverse"), 2).otherwise(1), F.greatest(F.size(ex) - 1, F.lit(0)))
    rows = g.select("doc_id", "coding", "exons", "strand", F.inline(inner))
    return rows.select("doc_id", "exon", genes.codon_at(F.col("coding"), ex, st, F.col("position")).alias("codon"))


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AL.members with a readable gene and its defline; one row a place of an alignment."""
    own = models(spark, sf_dir).select(F.col("row_id").alias("gene_row"), "chrom", "accno", "strand", "exons")
    return AL.members(spark, sf_dir).where("organism is not null and residues is not null").join(own, "gene_row")


@query(f"""WITH {AL.MEMBER}, gx AS (SELECT row_id, any_value(chrom) AS chrom, any_value(accno) AS accno, any_value(strand) AS strand, min(s) AS lo, max(e) AS hi, count(*) AS n, string_agg(s::VARCHAR || '..' || e::VARCHAR, ',' ORDER BY eidx) AS ex FROM exon GROUP BY row_id)
  SELECT m.alignment, m.seq_idx, {_lines("'#GENE'", "m.seq_idx::VARCHAR", "'organism ' || m.org", "'GP[''' || accno || ''' @ ' || chrom || strand || ':' || lo::VARCHAR || '..' || hi::VARCHAR || ' exons[' || n::VARCHAR || ']={' || ex || '}]'", "'defline ' || p.defline")} AS value
  FROM wmember m JOIN gx ON gx.row_id = m.gene_row JOIN protein_sequence p ON p.row_id = m.row_id""")
def gene_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The genes of each alignment."""
    deflines = table(spark, sf_dir, "protein_sequence").select("row_id", "defline")
    return report_lines.gene_lines(_aligned(spark, sf_dir).join(deflines, "row_id"))


@query(f"""WITH {AL.MEMBER}, v AS (SELECT m.alignment, m.seq_idx, m.org, CASE i.strand WHEN '-' THEN i.n - 2 - i.iidx ELSE i.iidx END AS nth, i.length AS len FROM wmember m JOIN intron i ON i.row_id = m.gene_row),
  f AS (SELECT *, CASE WHEN len < 4 THEN left('a' || repeat('{HI.FILLER.lower()}', 1), len) ELSE 'gt' || left('a' || repeat('{HI.FILLER.lower()}', (len // {len(HI.FILLER)} + 1)::INT), len - 4) || 'ag' END AS t FROM v)
  SELECT alignment, seq_idx, nth::INT AS nth, {_lines("'#INTRON'", "seq_idx::VARCHAR", "org", "nth::VARCHAR", "CASE WHEN len > 130 THEN left(t, 60) || '..' || (len - 120)::VARCHAR || '..' || right(t, 60) ELSE t END")} AS value FROM f""")
def aligned_intron_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The introns of each alignment's genes, cut from their pieces of contig, the middle of long ones left out."""
    local = F.transform("exons", lambda e: genes.exon(e["start"] - F.col("origin"), e["end"] - F.col("origin")))
    rows = evaluated(HI.members(spark, sf_dir), cut=genes.intron_sequences(F.col("dna"), local, F.col("strand")))
    return report_lines.intron_lines(rows)


@query(f"""WITH {AL.MEMBER}, {AL.CODING},
  reg AS (SELECT *, regexp_matches(ch, '^[ABCDEFGHIKLMNPQRSTVWXYZ*]$') AS ok FROM res),
  num AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY row_id ORDER BY col) - 1 AS r FROM reg),
  cod AS (SELECT num.*, CASE WHEN ok THEN substr(coalesce(k.coding, ''), (3 * r + 1)::BIGINT, 3) ELSE '' END AS codon FROM num LEFT JOIN coding k ON k.row_id = num.row_id),
  spot AS (SELECT cod.*, CASE WHEN x.strand = '-' THEN x.e - 1 - (3 * r - x.before) ELSE x.s + 3 * r - x.before END AS pos FROM cod LEFT JOIN exon_t x ON x.row_id = cod.gene_row AND ok AND 3 * r >= x.before AND 3 * r < x.before + x.e - x.s),
  fp AS (SELECT row_id, col, arg_min(phase, cds_offset) AS phase FROM (SELECT r.row_id, r.col, i.cds_offset, ((i.cds_offset - 1) % 3 + 1)::INT AS phase FROM ranked r JOIN intron i ON i.row_id = r.gene_row AND i.cds_offset > 0 AND (i.cds_offset - 1) // 3 = r.rank AND r.ch <> '-') GROUP BY ALL),
  cell AS (SELECT spot.alignment, spot.seq_idx, spot.col, coalesce(pos::BIGINT::VARCHAR, '-') || ':' || CASE WHEN length(codon) = 3 AND NOT contains(codon, 'N') THEN {_codon(SQ.index("codon", 3))} ELSE '---/-' END || coalesce('^' || fp.phase::VARCHAR, '') AS text FROM spot LEFT JOIN fp ON fp.row_id = spot.row_id AND fp.col = spot.col),
  w AS (SELECT alignment, unnest(range(0, max(length(residues)))) AS col FROM wmember GROUP BY alignment),
  full_ AS (SELECT w.alignment, w.col, m.seq_idx, coalesce(c.text, '') AS text FROM w JOIN wmember m ON m.alignment = w.alignment LEFT JOIN cell c ON c.alignment = w.alignment AND c.col = w.col AND c.seq_idx = m.seq_idx)
  SELECT alignment, col::INT AS col, {_lines("'#ALIGNMENT'", "col::VARCHAR", "string_agg(text, chr(9) ORDER BY seq_idx)")} AS value FROM full_ GROUP BY alignment, col""")
def alignment_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each column of each alignment, with every sequence's codon, its position and the introns behind it."""
    offsets = F.transform(genes.introns(F.col("exons"), F.col("strand")), lambda i: i["cds_offset"])
    rows = evaluated(_aligned(spark, sf_dir), coding=AL.coding(), offsets=offsets, taken=alignment.positions_where(alignment.letters("residues"), S.is_regular))
    return report_lines.alignment_lines(alignment.placed_introns(alignment.aligned_codons(rows)))
