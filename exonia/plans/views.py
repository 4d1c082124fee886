"""Domain views of the given tables, and the SQL common table expressions that give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exonia.operators import genes
from exonia.session import table


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gene models of genepred that can be read and aren't faulty, exons fused."""
    raw = table(spark, sf_dir, "genepred").where(F.col("gene").isNotNull() & F.col("strand").isNotNull())
    clean = genes.sanitised(genes.models_of(raw.select("row_id", "organism", "chrom", "gene", "accno", "strand", "exonstarts", "exonends", "loaded_at")))
    return clean.where(F.coalesce(F.col("problem"), F.lit("")).isin("", "short"))


#: exon(row_id, organism, chrom, gene, accno, strand, loaded_at, eidx, s, e, n): the exons of the same models; n to a model.
EXON = """
  x_raw AS (
    SELECT row_id, unnest(s)::BIGINT AS s, unnest(e)::BIGINT AS e
    FROM (SELECT *, regexp_extract_all(exonstarts, '[0-9]+') AS s, regexp_extract_all(exonends, '[0-9]+') AS e FROM genepred)
    WHERE len(s) = len(e) AND gene IS NOT NULL AND strand IS NOT NULL),
  x_lag AS (SELECT *, lag(e) OVER (PARTITION BY row_id ORDER BY s, e) AS pe, lead(s) OVER (PARTITION BY row_id ORDER BY s, e) AS ns FROM x_raw),
  x_bad AS (SELECT DISTINCT row_id FROM x_lag WHERE e < s OR s < pe),
  x_island AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY row_id ORDER BY s, e) AS k FROM x_lag WHERE row_id NOT IN (SELECT row_id FROM x_bad)),
  x_fused AS (SELECT row_id, (k - 1)::INT AS eidx, min(s)::INT AS s, max(e)::INT AS e FROM x_island GROUP BY row_id, k),
  exon AS (
    SELECT f.row_id, g.organism, g.chrom, g.gene, g.accno, g.strand, g.loaded_at, f.eidx, f.s, f.e, count(*) OVER (PARTITION BY f.row_id)::INT AS n
    FROM x_fused f JOIN genepred g ON f.row_id = g.row_id)"""

#: exon_t: exon with `before`, the coding length before it in transcription order; intron: the introns in that order.
INTRON = (
    EXON
    + """,
  exon_t AS (
    SELECT *, coalesce(sum(e - s) OVER (PARTITION BY row_id ORDER BY CASE strand WHEN '-' THEN -eidx ELSE eidx END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS before,
      lead(s) OVER (PARTITION BY row_id ORDER BY eidx) AS next_s FROM exon),
  intron AS (
    SELECT row_id, organism, chrom, gene, accno, strand, n, CASE strand WHEN '-' THEN n - 2 - eidx ELSE eidx END AS iidx,
      CASE strand WHEN '-' THEN next_s - 1 ELSE e END AS donor_pos, CASE strand WHEN '-' THEN e ELSE next_s - 1 END AS acceptor_pos,
      next_s - e AS length, CASE strand WHEN '-' THEN before ELSE before + e - s END AS cds_offset
    FROM exon_t WHERE next_s IS NOT NULL)"""
)
