"""The queries of problems 2, 6, 7 and 8, and SQL where it gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exonia.llm import cutting, encoding, packing, quantiles
from exonia.session import table

GROUP = ["organism", "chrom", "measure"]


def limits(spark: SparkSession, sf_dir: str, purpose: str) -> list[tuple]:
    """The limits of one purpose: settings, which are read by the driver."""
    rows = table(spark, sf_dir, "token_limit").where(F.col("purpose") == purpose).orderBy("limit_id").limit(1000).collect()
    if len(rows) == 1000:
        raise ValueError("token_limit holds settings; it has too many rows")
    return [(r.limit_id, r.tokenizer, r.capacity, r.overlap or 0) for r in rows]


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.summaries(quantiles.exon_values(table(spark, sf_dir, "genepred")), GROUP, "load_day", "value")


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quantiles.percentiles(_days(spark, sf_dir), GROUP)
    return got.select("organism", "chrom", quantiles.named_measure().alias("measure"), "percent", "value", "n")


def p2_day_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(spark, sf_dir).select("organism", "chrom", quantiles.named_measure().alias("measure"), F.col("load_day").cast("string").alias("load_day"), "value", "weight")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encoded(table(spark, sf_dir, "documents"))


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.decoded(p6_ids(spark, sf_dir))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.containers(table(spark, sf_dir, "documents"), [x[:3] for x in limits(spark, sf_dir, "pack")])


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each limit are."""
    return (
        p7_containers(spark, sf_dir)
        .groupBy("limit_id", "container")
        .agg(F.sum("n_tokens").alias("fill"))
        .groupBy("limit_id")
        .agg(F.count("*").alias("containers"), F.sum("fill").alias("tokens"), F.max("fill").alias("fullest"))
    )


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutting.pieces(table(spark, sf_dir, "documents"), limits(spark, sf_dir, "cut"))


QUERIES = {f.__name__: f for f in (p2_percentiles, p2_day_summaries, p6_ids, p6_decoded, p7_containers, p7_fill, p8_pieces)}

_VALUES = """
  SELECT organism, chrom, day, unnest(['exon_start', 'exon_end', 'exon_length']) AS measure, unnest([s, e, e - s]) AS value
  FROM (SELECT organism, chrom, strftime(loaded_at, '%Y-%m-%d') AS day, unnest(s)::BIGINT AS s, unnest(e)::BIGINT AS e
        FROM (SELECT *, regexp_extract_all(exonstarts, '[0-9]+') AS s, regexp_extract_all(exonends, '[0-9]+') AS e FROM genepred) WHERE len(s) = len(e))
  WHERE e > s"""

#: The SQL of problem 2 is exact. It gives the queries' rows only while every (organism, chrom, measure, day) has fewer than
#: 400 values; from 400 on a day is thinned, values may lie 0.5 % of ranks off and the SQL no longer applies.
ORACLE = {
    "p2_percentiles": f"""
      WITH v AS ({_VALUES}), c AS (SELECT organism, chrom, measure, value, count(*) AS k FROM v GROUP BY ALL),
      r AS (SELECT *, sum(k) OVER (PARTITION BY organism, chrom, measure ORDER BY value) AS upto, sum(k) OVER (PARTITION BY organism, chrom, measure) AS n FROM c)
      SELECT organism, chrom, measure, percent, min(value) AS value, any_value(n)::BIGINT AS n
      FROM r, (SELECT unnest([1, 5, 25, 50, 75, 95, 99])::INT AS percent) WHERE upto * 100 >= n * percent GROUP BY ALL""",
    "p2_day_summaries": f"SELECT organism, chrom, measure, day AS load_day, value, count(*) AS weight FROM ({_VALUES}) GROUP BY ALL",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
