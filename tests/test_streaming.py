"""Counts of micro-batches add up to those of all files."""

from datetime import datetime

from exonia.streaming import counters
from pyspark.sql import functions as F


def test_batches_add_up(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "counts")
    one = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "organism string, length int")
    one.coalesce(1).write.parquet(source)
    count = lambda b: b.groupBy("organism", "length").agg(F.count("*").alias("n"))
    stream = lambda: spark.readStream.schema(one.schema).parquet(source)
    counters.merged_counts(stream(), count, folder, str(tmp_path / "cp")).awaitTermination(60)
    one.where("organism = 'a'").coalesce(1).write.mode("append").parquet(source)
    counters.merged_counts(stream(), count, folder, str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(map(tuple, counters.totals(spark, folder).collect())) == [("a", 1, 2), ("a", 2, 2), ("b", 1, 1)]


def test_windows_of_load_times(spark, tmp_path):
    rows = spark.createDataFrame([("a", datetime(2024, 1, 1, 3)), ("a", datetime(2024, 1, 1, 9)), ("b", datetime(2024, 1, 2))], "organism string, loaded_at timestamp_ntz")
    assert sorted(r.n for r in counters.late_exon_counts(rows).collect()) == [1, 2]


def test_late_rows_of_a_stream(spark, tmp_path):
    """A row behind the watermark isn't counted any more; one within it is."""
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    kind = "organism string, loaded_at timestamp_ntz"
    batches = [[("a", datetime(2024, 1, 1, 3)), ("a", datetime(2024, 1, 20))], [("a", datetime(2024, 1, 18)), ("a", datetime(2024, 1, 1, 4)), ("b", datetime(2024, 2, 20))], [("b", datetime(2024, 3, 20))]]
    for rows in batches:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
        stream = counters.late_exon_counts(spark.readStream.schema(kind).parquet(source)).select("window.start", "organism", "n")
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start(folder).awaitTermination(90)
    got = {(r.start.day, r.start.month, r.organism): r.n for r in spark.read.parquet(folder).collect()}
    assert got == {(1, 1, "a"): 1, (18, 1, "a"): 1, (20, 1, "a"): 1, (20, 2, "b"): 1}
