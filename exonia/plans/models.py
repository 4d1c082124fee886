"""Queries on gene models (genepred, gff, contig and protein_sequence), each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exonia.functions import special
from exonia.operators import genes, lengths
from exonia.plans.general import _pieces
from exonia.plans.views import EXON, INTRON, models
from exonia.session import digits, evaluated, table
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




def ex():
    return F.col("exons")


def st():
    return F.col("strand")


LISTS = "string_agg(s::VARCHAR, ',' ORDER BY eidx) AS starts, string_agg(e::VARCHAR, ',' ORDER BY eidx) AS ends"


def joined(part: str, exons=None):
    return F.array_join(F.transform(ex() if exons is None else exons, lambda e: e[part].cast("string")), ",")


@query("""
  WITH raw AS (
    SELECT row_id, unnest(s)::BIGINT AS s, unnest(e)::BIGINT AS e, len(s)::INT AS n
    FROM (SELECT row_id, regexp_extract_all(exonstarts, '[0-9]+') AS s, regexp_extract_all(exonends, '[0-9]+') AS e FROM genepred) WHERE len(s) = len(e)),
  o AS (SELECT *, s - lag(e) OVER (PARTITION BY row_id ORDER BY s, e) AS gap FROM raw)
  SELECT row_id, any_value(n) AS n_listed, (count(*) - count(*) FILTER (WHERE gap = 0))::INT AS n_exons,
    CASE WHEN bool_or(s > e) THEN 'negative' WHEN coalesce(bool_or(gap < 0), false) THEN 'overlap' WHEN coalesce(bool_or(gap IN (1, 2)), false) THEN 'short' END AS problem
  FROM o GROUP BY row_id HAVING NOT bool_or(s > e)""")
def model_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models with touching exons fused, and what else is wrong with them (those with negative exons are left out)."""
    raw = genes.models_of(table(spark, sf_dir, "genepred").select("row_id", "exonstarts", "exonends")).withColumn("n_listed", F.size("exons"))
    return genes.sanitised(raw).where("problem is null or problem <> 'negative'").select("row_id", "n_listed", F.size("exons").alias("n_exons"), "problem")


@query(f"WITH {INTRON} SELECT row_id, eidx, ((3 - before % 3) % 3)::INT AS phase FROM exon_t")
def exon_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1"""
    return models(spark, sf_dir).select("row_id", F.posexplode(genes.exon_phases(ex(), st())).alias("eidx", "phase"))


@query(f"WITH {INTRON} SELECT row_id, iidx::INT AS iidx, donor_pos::INT AS donor_pos, acceptor_pos::INT AS acceptor_pos, length::INT AS length, cds_offset::INT AS cds_offset, (cds_offset % 3)::INT AS phase FROM intron")
def introns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Introns in transcription order with splice-site positions and coding offsets."""
    return models(spark, sf_dir).select("row_id", F.inline(genes.introns(ex(), st())))


_HISTOGRAM = f"""
  WITH {INTRON}, h AS (
    SELECT organism, 'exon_count' AS kind, n AS value, count(*) AS n FROM exon WHERE eidx = 0 GROUP BY ALL
    UNION ALL SELECT organism, 'exon_length', e - s, count(*) FROM exon GROUP BY ALL
    UNION ALL SELECT organism, 'intron_length', length, count(*) FROM intron GROUP BY ALL)"""


@query(_HISTOGRAM + " SELECT organism, kind, value::INT AS value, n FROM h")
def length_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exon counts, exon lengths and intron lengths per organism."""
    return genes.length_histograms(models(spark, sf_dir))


@query(f"WITH {INTRON}, p AS (SELECT organism, (cds_offset % 3)::INT AS phase, lag((cds_offset % 3)::INT, 1, -1) OVER (PARTITION BY row_id ORDER BY iidx) AS before FROM intron) SELECT organism, before, phase, count(*) AS n FROM p GROUP BY ALL")
def phase_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12, W3"""
    return genes.phase_transitions(models(spark, sf_dir))


@query(
    _HISTOGRAM
    + """ SELECT organism, kind, sum(n)::BIGINT AS total, round(sum(value * n)::DOUBLE / sum(n), 4) AS mean, arg_max(value, n * 1000000000 - value)::INT AS mode,
      round(sum(value::DOUBLE * value * n) / sum(n) - (sum(value::DOUBLE * n) / sum(n)) ^ 2, 4) AS variance FROM h GROUP BY ALL"""
)
def length_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14"""
    s = genes.length_statistics(length_histograms(spark, sf_dir), ["organism", "kind"])
    return s.select("organism", "kind", "total", F.round("mean", 4).alias("mean"), "mode", F.round("variance", 4).alias("variance"))


@query(
    _HISTOGRAM
    + """, top AS (SELECT organism, max(value) AS m FROM h WHERE kind = 'exon_count' GROUP BY organism),
    v AS (SELECT organism, unnest(range(0, m + 1)) AS value FROM top)
    SELECT v.organism, v.value::INT AS value, coalesce(h.n, 0) AS n FROM v LEFT JOIN h ON h.kind = 'exon_count' AND h.organism = v.organism AND h.value = v.value"""
)
def dense_exon_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13"""
    h = length_histograms(spark, sf_dir).where("kind = 'exon_count'").drop("kind")
    return genes.dense_counts(h, ["organism"])


@query(_HISTOGRAM + " SELECT organism, kind, value::INT AS value, n, row_number() OVER (PARTITION BY organism, kind ORDER BY n DESC, value)::INT AS nth FROM h WHERE kind = 'exon_count'")
def counter_by_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, O2: the keys of a counter by falling frequency, equal ones by key."""
    from pyspark.sql import Window

    h = length_histograms(spark, sf_dir).where("kind = 'exon_count'")
    return h.withColumn("nth", F.row_number().over(Window.partitionBy("organism", "kind").orderBy(F.desc("n"), "value")))


@query(f"""
  WITH {INTRON}, i AS (SELECT row_id, string_agg(cds_offset::VARCHAR, ',' ORDER BY iidx) AS ipos, string_agg(length::VARCHAR, ',' ORDER BY iidx) AS ilen FROM intron GROUP BY row_id),
  m AS (SELECT row_id, any_value(organism) AS organism, any_value(chrom) AS chrom, any_value(accno) AS accno, any_value(strand) AS strand, sum(e - s)::INT AS len, min(s) AS lo, {LISTS} FROM exon GROUP BY row_id)
  SELECT m.row_id, concat_ws(chr(9), chrom, accno, accno, 'full', strand, CASE WHEN len % 3 = 0 THEN (len // 3)::VARCHAR ELSE (len / 3.0::DOUBLE)::VARCHAR END,
    coalesce(ipos, '00'), coalesce(ilen, '00'), accno, organism, (lo + 1)::VARCHAR, starts, ends) AS line
  FROM m LEFT JOIN i ON m.row_id = i.row_id""")
def annotation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1"""
    return models(spark, sf_dir).select("row_id", text_lines.annotation_line(F.col("accno")).alias("line"))


@query(f"""
  WITH {EXON} SELECT row_id, concat_ws(chr(9), any_value(accno), any_value(chrom), any_value(strand), min(s)::VARCHAR, max(e)::VARCHAR, min(s)::VARCHAR, max(e)::VARCHAR, count(*)::VARCHAR,
    string_agg(s::VARCHAR || ',', '' ORDER BY eidx), string_agg(e::VARCHAR || ',', '' ORDER BY eidx)) AS line FROM exon GROUP BY row_id""")
def known_gene_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2"""
    return models(spark, sf_dir).select("row_id", text_lines.known_gene_line(F.col("accno")).alias("line"))


@query(f"WITH {INTRON} SELECT row_id, eidx, concat_ws(chr(9), chrom, 'exonia', 'CDS', (s + 1)::VARCHAR, e::VARCHAR, '.', strand, ((3 - before % 3) % 3)::VARCHAR, 'ID=' || accno) AS line FROM exon_t")
def gff3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3"""
    return models(spark, sf_dir).select("row_id", F.posexplode(text_lines.gff3_lines(F.col("accno"), "exonia")).alias("eidx", "line"))


@query("""
  SELECT row_id, organism, accno FROM (SELECT *, row_number() OVER (PARTITION BY organism, accno ORDER BY loaded_at DESC, row_id DESC) AS k FROM genepred WHERE accno IS NOT NULL) WHERE k = 1""")
def last_delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of models delivered again the last one."""
    t = table(spark, sf_dir, "genepred").select("row_id", "organism", "accno", "loaded_at")
    return genes.last_wins(t, ["organism", "accno"], ["loaded_at", "row_id"]).select("row_id", "organism", "accno")


@query("SELECT row_id FROM genepred g WHERE EXISTS (SELECT 1 FROM contig c WHERE c.organism = g.organism AND c.chrom = g.chrom)")
def models_on_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8, P4, J2 (semi-join): models whose contig is known."""
    return table(spark, sf_dir, "genepred").join(table(spark, sf_dir, "contig"), ["organism", "chrom"], "left_semi").select("row_id")


@query(f"""
  WITH {EXON}, c AS (SELECT organism, chrom, max(n_bases) AS n_bases FROM contig GROUP BY ALL)
  SELECT x.organism, x.chrom, any_value(c.n_bases) AS n_bases, count(DISTINCT row_id) AS models, sum(e - s)::BIGINT AS coding FROM exon x JOIN c ON x.organism = c.organism AND x.chrom = c.chrom GROUP BY ALL""")
def coding_per_contig(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models and coding bases of each contig; models are summed up before the join, so that no contig is hot in it."""
    own = models(spark, sf_dir).groupBy("organism", "chrom").agg(F.count("*").alias("models"), F.sum(genes.coding_length(ex())).alias("coding"))
    contig = table(spark, sf_dir, "contig").groupBy("organism", "chrom").agg(F.max("n_bases").alias("n_bases"))
    return own.join(contig, ["organism", "chrom"]).select("organism", "chrom", "n_bases", "models", "coding")


_GENE_OF = """
  g_last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY organism, accno ORDER BY loaded_at DESC, row_id DESC) AS k FROM genepred WHERE organism IS NOT NULL AND accno IS NOT NULL) WHERE k = 1),
  g_any AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY accno ORDER BY organism) AS k2 FROM g_last) WHERE k2 = 1),
  gene_of AS (
    SELECT p.row_id, coalesce(g.row_id, a.row_id) AS gene_row, coalesce(g.organism, a.organism) AS gene_organism FROM protein_sequence p
    LEFT JOIN g_last g ON p.organism = g.organism AND p.seq_id = g.accno LEFT JOIN g_any a ON p.organism IS NULL AND p.seq_id = a.accno)"""


@query(f"WITH {_GENE_OF} SELECT row_id, gene_row, gene_organism FROM gene_of")
def protein_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gene of each protein, by organism and name, or by name alone where the organism is unknown."""
    t = table(spark, sf_dir, "genepred").select("row_id", "organism", "accno", "loaded_at")
    last = genes.last_wins(t, ["organism", "accno"], ["loaded_at", "row_id"])
    got = genes.with_gene(table(spark, sf_dir, "protein_sequence"), last)
    return got.select("row_id", F.col("gene_row.row_id").alias("gene_row"), F.col("gene_row.organism").alias("gene_organism"))


@query(f"""
  WITH {EXON}, r AS (SELECT *, min(s) OVER (PARTITION BY row_id) + 50 AS lo, min(s) OVER (PARTITION BY row_id) + 650 AS hi FROM exon)
  SELECT row_id, greatest(s, lo)::INT AS "start", least(e, hi)::INT AS "end" FROM r WHERE greatest(s, lo) < least(e, hi)""")
def clipped_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exons cut to a region of each model."""
    lo = F.get(ex(), 0)["start"]
    return models(spark, sf_dir).select("row_id", F.inline(genes.clipped(ex(), lo + 50, lo + 650)))


@query(f"""
  WITH {INTRON}, k AS (SELECT unnest([0, 99, 300]) AS off)
  SELECT row_id, off::INT AS cds_offset, (CASE strand WHEN '-' THEN e - 1 - (off - before) ELSE s + off - before END)::INT AS position, eidx FROM exon_t, k WHERE off >= before AND off < before + e - s""")
def offset_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where coding offsets lie, and the exon that holds the place."""
    m = models(spark, sf_dir).select("row_id", "exons", "strand", F.explode(F.array(*map(F.lit, (0, 99, 300)))).alias("cds_offset"))
    at = m.withColumn("position", genes.position_of_offset(ex(), st(), F.col("cds_offset"))).where("position is not null")
    return at.select("row_id", "cds_offset", "position", genes.containing_exon(ex(), F.col("position")).alias("eidx"))


_EDIT = f"""
  WITH {INTRON}, f AS (SELECT row_id, strand, donor_pos AS d, acceptor_pos AS a, length FROM intron WHERE iidx = 0 AND length >= 12),
  e5 AS (SELECT x.*, f.d, f.a, f.length FROM exon x JOIN f ON x.row_id = f.row_id)"""


@query(
    _EDIT
    + f""", moved AS (
    SELECT row_id, 'donor' AS edit, eidx, CASE WHEN strand = '-' AND s = d + 1 THEN d - 2 ELSE s END AS s, CASE WHEN strand <> '-' AND e = d THEN d + 3 ELSE e END AS e FROM e5
    UNION ALL SELECT row_id, 'acceptor', eidx, CASE WHEN strand <> '-' AND s = a + 1 THEN a - 2 ELSE s END, CASE WHEN strand = '-' AND e = a THEN a + 3 ELSE e END FROM e5
    UNION ALL SELECT row_id, 'exonify', min(eidx), min(s), max(e) FROM (SELECT *, CASE WHEN e = CASE strand WHEN '-' THEN a ELSE d END OR s = 1 + CASE strand WHEN '-' THEN d ELSE a END THEN -1 ELSE eidx END AS grp FROM e5) GROUP BY row_id, grp)
  SELECT row_id, edit, {LISTS} FROM moved GROUP BY row_id, edit"""
)
def model_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first intron's donor and acceptor moved into it by 3, and the intron removed."""
    m = evaluated(models(spark, sf_dir), i=F.get(genes.introns(ex(), st()), 0)).where("i.length >= 12")
    step = F.when(st() == "-", -1).otherwise(1)
    d, a = F.col("i.donor_pos"), F.col("i.acceptor_pos")
    edits = F.array(
        F.struct(F.lit("donor").alias("edit"), genes.shift_site(ex(), st(), d + 3 * step, True).alias("to")),
        F.struct(F.lit("acceptor").alias("edit"), genes.shift_site(ex(), st(), a - 3 * step, False).alias("to")),
        F.struct(F.lit("exonify").alias("edit"), genes.exonify(ex(), st(), d, a).alias("to")),
    )
    return m.select("row_id", F.inline(edits)).select("row_id", "edit", joined("start", F.col("to")).alias("starts"), joined("end", F.col("to")).alias("ends"))


@query(
    f"""WITH {EXON}, k AS (SELECT row_id, min(eidx) AS at FROM exon WHERE e - s >= 90 GROUP BY row_id),
  c AS (SELECT x.*, coalesce(x.eidx = k.at, false) AS cut FROM exon x LEFT JOIN k ON x.row_id = k.row_id),
  b AS (SELECT row_id, eidx * 2 AS eidx, s, CASE WHEN cut THEN s + 30 ELSE e END AS e FROM c UNION ALL SELECT row_id, eidx * 2 + 1, e - 30, e FROM c WHERE cut)
  SELECT row_id, {LISTS} FROM b GROUP BY row_id"""
)
def intronified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An intron put into each model's first exon of 90 or more bases, 30 bases from both ends."""
    m = evaluated(models(spark, sf_dir), x=F.get(F.filter(ex(), lambda e: e["end"] - e["start"] >= 90), 0))
    lo, hi = F.col("x.start") + 30, F.col("x.end") - 31
    d, a = F.when(st() == "-", hi).otherwise(lo), F.when(st() == "-", lo).otherwise(hi)
    m = m.withColumn("exons", F.when(F.col("x").isNull(), ex()).otherwise(genes.intronify(ex(), st(), d, a)))
    return m.select("row_id", joined("start").alias("starts"), joined("end").alias("ends"))


@query(f"WITH {EXON} SELECT row_id, {LISTS} FROM exon GROUP BY row_id")
def intronify_exonify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An intron put into each model's first long exon and taken out again leaves the model as it was."""
    long = F.get(F.filter(ex(), lambda e: e["end"] - e["start"] >= 90), 0)
    m = evaluated(models(spark, sf_dir), x=long)
    lo, hi = F.col("x.start") + 30, F.col("x.end") - 31
    d, a = F.when(st() == "-", hi).otherwise(lo), F.when(st() == "-", lo).otherwise(hi)
    back = genes.exonify(genes.intronify(ex(), st(), d, a), st(), d, a)
    m = m.withColumn("exons", F.when(F.col("x").isNull(), ex()).otherwise(back))
    return m.select("row_id", joined("start").alias("starts"), joined("end").alias("ends"))


@query(f"""
  WITH {EXON} SELECT row_id, 'GP[''' || any_value(accno) || ''' @ ' || any_value(chrom) || any_value(strand) || ':' || min(s)::VARCHAR || '..' || max(e)::VARCHAR || ' exons[' || count(*)::VARCHAR || ']={{'
    || string_agg(s::VARCHAR || '..' || e::VARCHAR, ',' ORDER BY eidx) || '}}]' AS text FROM exon GROUP BY row_id""")
def model_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P13"""
    return models(spark, sf_dir).select("row_id", genes.short_text(F.col("accno"), F.col("chrom"), st(), ex(), True).alias("text"))


_CDS_ROWS = f"""
  WITH q AS (SELECT row_id, organism, gff_seqid, gff_start, gff_end, gff_strand, dialect, {_pieces("gff_attr")} AS ps FROM gff WHERE gff_type = 'CDS' AND gff_attr IS NOT NULL),
  k AS (SELECT *, list_filter(ps, lambda x: x.k = CASE dialect WHEN 'gff3' THEN 'ID' WHEN 'gtf' THEN 'transcript_id' WHEN 'jgi' THEN 'proteinId' END)[1].v AS raw FROM q),
  c AS (SELECT *, organism || '|' || regexp_replace(raw, '^[^:]*:', '') AS ident FROM k WHERE coalesce(raw, '') <> '')"""


@query(_CDS_ROWS + " SELECT row_id, ident FROM c")
def gff_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gene that each CDS line names, by its dialect's key, with the organism as prefix."""
    return text_lines.gff_identified(table(spark, sf_dir, "gff").where("gff_type = 'CDS'")).select("row_id", "ident")


@query(
    _CDS_ROWS
    + """, u AS (SELECT DISTINCT organism, ident, gff_start - 1 AS s, gff_end AS e FROM c),
    m AS (SELECT organism, ident, min(trim(gff_seqid, ' ')) AS chrom, coalesce(min(CASE WHEN gff_strand <> '.' THEN gff_strand END), '.') AS strand, count(DISTINCT trim(gff_seqid, ' ')) > 1 AS seqids_differ,
      count(DISTINCT CASE WHEN gff_strand <> '.' THEN gff_strand END) > 1 AS strands_differ FROM c GROUP BY ALL)
    SELECT m.organism, m.ident, m.chrom, m.strand, m.seqids_differ, m.strands_differ, x.starts, x.ends
    FROM m JOIN (SELECT organism, ident, string_agg(s::VARCHAR, ',' ORDER BY s, e) AS starts, string_agg(e::VARCHAR, ',' ORDER BY s, e) AS ends FROM u GROUP BY ALL) x ON m.organism = x.organism AND m.ident = x.ident"""
)
def gff_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gene models of the CDS lines, exons sorted, lines delivered again once, contradictions flagged."""
    m = text_lines.gff_models(table(spark, sf_dir, "gff"))
    return m.select("organism", "ident", "chrom", "strand", "seqids_differ", "strands_differ", joined("start").alias("starts"), joined("end").alias("ends"))


@query("""
  SELECT row_id, CASE WHEN regexp_matches(defline, '/organism=') THEN coalesce(nullif(regexp_extract(defline, '/organism="([^"]*)"', 1), ''), nullif(regexp_extract(defline, '/organism=''([^'']*)''', 1), ''), nullif(regexp_extract(defline, '/organism=([^ "'']+)', 1), '')) END AS organism_tag,
    split_part(defline, ' ', 1) AS ident FROM protein_sequence""")
def defline_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4"""
    from exonia.functions.seq import ident, tag

    return table(spark, sf_dir, "protein_sequence").select("row_id", tag("defline", "organism").alias("organism_tag"), ident("defline").alias("ident"))


@query("""
  SELECT organism, sum(len(s))::BIGINT AS starts, count(*) AS lists FROM (SELECT organism, regexp_extract_all(exonstarts, '[0-9]+') AS s FROM genepred WHERE exonstarts IS NOT NULL) GROUP BY ALL""")
def list_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed exon lists as arrays."""
    t = table(spark, sf_dir, "genepred").where("exonstarts is not null")
    return t.groupBy("organism").agg(F.sum(F.size(digits("exonstarts"))).alias("starts"), F.count("*").alias("lists"))


@query(_HISTOGRAM + " SELECT organism, concat_ws(chr(9), '#' || upper(kind), value::VARCHAR, n::VARCHAR) AS value FROM h")
def histogram_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K13"""
    return report_lines.histogram_lines(length_histograms(spark, sf_dir))


@query(_HISTOGRAM + " SELECT DISTINCT value::INT AS value, round(lgamma(value + 1), 6) AS log_factorial, round(value * ln(60) - 60 - lgamma(value + 1), 6) AS poisson FROM h WHERE kind = 'intron_length'")
def length_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Special functions of every intron length, as expressions."""
    v = length_histograms(spark, sf_dir).where("kind = 'intron_length'").select("value").distinct()
    x = F.col("value")
    return v.select("value", F.round(special.factln_column(x), 6).alias("log_factorial"), F.round(special.poisson_ln_column(F.lit(60.0), x), 6).alias("poisson"))


@query(
    _HISTOGRAM
    + """ SELECT DISTINCT value::INT AS value, round(ln(0.4) + value * ln(60) - 60 - lgamma(value + 1), 6) AS short_log, CASE WHEN value >= 1 THEN round(ln(0.6) + ln(0.01) + (value - 1) * ln(0.99), 6) END AS long_log,
      round(ln(0.4) - 60, 6) AS open, CASE WHEN value > 0 THEN round(ln(60) - ln(value), 6) END AS advance FROM h WHERE kind = 'intron_length'"""
)
def length_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What both parts of a length model (weight 0.4, rate 60, fail 0.99, shift 1) give for every intron length, and the
    steps that a short intron's score is made of."""
    v = length_histograms(spark, sf_dir).where("kind = 'intron_length'").select("value").distinct()
    x, weight, rate, fail, shift = F.col("value"), F.lit(0.4), F.lit(60.0), F.lit(0.99), F.lit(1)
    got = {"short_log": lengths.short_log(x, weight, rate), "long_log": lengths.long_log(x, weight, fail, shift), "open": lengths.open_score(weight, rate), "advance": F.when(x > 0, lengths.advance_score(x, rate))}
    return v.select("value", *(F.round(c, 6).alias(n) for n, c in got.items()))


@query(
    _HISTOGRAM
    + """, l AS (SELECT organism, value::DOUBLE AS v, n::DOUBLE AS n FROM h WHERE kind = 'intron_length'),
    m AS (SELECT organism, sum(n) AS total, sum(v * n) / sum(n) AS mean, sum(v * v * n) / sum(n) AS square, arg_max(v, n * 1e9 - v) AS mode FROM l GROUP BY organism),
    b AS (SELECT m.*, (SELECT coalesce(sum(n), 0) FROM l WHERE l.organism = m.organism AND l.v < m.mode) / total AS before, list_sum(list_transform(range(0, mode::INT), lambda k: exp(k * ln(mode) - mode - lgamma(k + 1)))) AS below FROM m),
    w AS (SELECT *, before / below AS weight FROM b),
    f AS (SELECT *, 1 - (1 - weight) / (mean - weight * mode) AS fail FROM w),
    g AS (SELECT organism, CASE WHEN weight BETWEEN 0 AND 1 THEN weight ELSE 0.5 END AS weight, mode AS rate, CASE WHEN fail BETWEEN 0 AND 1 THEN fail ELSE 0.5 END AS fail, trunc(mean + 3 * sqrt(greatest(square - mean * mean, 0))) AS longest FROM f)
    SELECT organism, round(weight, 6) AS weight, rate, round(fail, 6) AS fail,
      round(sum(n * (greatest(p, q) + ln(1 + exp(least(p, q) - greatest(p, q))))), 3) AS log_likelihood
    FROM (SELECT g.organism, weight, rate, fail, n, ln(greatest(weight, 1e-300)) + v * ln(rate) - rate - lgamma(v + 1) AS p, ln(greatest(1 - weight, 1e-300)) + ln(greatest(1 - fail, 1e-300)) + (v - 1) * ln(greatest(fail, 1e-300)) AS q FROM g JOIN l ON g.organism = l.organism AND v > 0 AND v <= longest) GROUP BY organism, weight, rate, fail"""
)
def intron_length_guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the fit of each organism's mixture begins, and how likely its lengths are under it."""
    got = lengths.guessed(length_histograms(spark, sf_dir).where("kind = 'intron_length'"))
    return got.select("organism", F.round("weight", 6).alias("weight"), "rate", F.round("fail", 6).alias("fail"), F.round("log_likelihood", 3).alias("log_likelihood"))


@query()
def intron_length_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each organism's mixture, fitted to its histogram."""
    return lengths.fitted(length_histograms(spark, sf_dir).where("kind = 'intron_length'"))
