"""Sequence files and where they come from."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exonia.functions import seq as S


def local_path(spark: SparkSession, path: str) -> str:
    """A path that tasks can read: as it is, or for http and ftp addresses the copy that Spark gives every node. Files in
    .gz are inflated by the readers; archives of several files must be unpacked first."""
    if path.endswith(".zip"):
        raise ValueError(f"{path}: unpack zip archives first")
    if path.split(":", 1)[0] in ("http", "https", "ftp"):
        from pyspark import SparkFiles

        spark.sparkContext.addFile(path)
        return "file://" + SparkFiles.get(os.path.basename(path))
    return path


def named_files(spec: str, required: bool = False) -> list[tuple[str, str]]:
    """(organism, file) of "org=file,org=file"; a file without organism belongs to "", unless one is required."""
    out = []
    for part in spec.split(","):
        organism, eq, path = part.partition("=")
        if required and not eq:
            raise ValueError(f"an organism is needed: org={part}")
        out.append((organism, path) if eq else ("", part))
    return out


def records(spark: SparkSession, path: str) -> DataFrame:
    """(defline, ident, body) of a FASTA file: one row a record, its sequence lines trimmed and joined. Lines that begin
    with `;` and blank lines don't count; a record without sequence has an empty body."""
    raw = spark.read.option("lineSep", "\n>").text(local_path(spark, path))
    lines = F.transform(F.split(F.regexp_replace("value", "^>", ""), "\n"), lambda x: F.trim(x, F.lit(" \t\r")))
    rows = raw.where(~F.col("value").startswith(";") & (F.trim("value", F.lit(" \t\r\n")) != "")).select(lines.alias("lines"))
    body = F.array_join(F.filter(F.slice("lines", F.lit(2), F.size("lines")), lambda x: (x != "") & ~x.startswith(";")), "")
    defline = F.get("lines", 0)
    return rows.select(defline.alias("defline"), S.ident(defline).alias("ident"), body.alias("body"))


def genome(spark: SparkSession, path: str, organism: str | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """(organism, chrom, defline, seq BINARY) of a DNA file. The organism is the given one, otherwise the defline's tag.
    wanted: a table with `defline`; only these sequences are kept."""
    rows = records(spark, path)
    if wanted is not None:
        rows = rows.join(wanted.select("defline").distinct(), "defline", "left_semi")
    name = F.lit(organism) if organism else S.tag("defline", "organism")
    return rows.select(name.alias("organism"), F.col("ident").alias("chrom"), "defline", F.to_binary(S.dna("body"), F.lit("utf-8")).alias("seq"))


def genomes(spark: SparkSession, spec: str) -> DataFrame:
    """The genomes of "org=file,org=file"; files of one organism are put together, of equal contigs the last file's wins."""
    out = None
    for k, (organism, path) in enumerate(named_files(spec)):
        part = genome(spark, path, organism or None).withColumn("_k", F.lit(k))
        out = part if out is None else out.unionByName(part)
    best = out.groupBy("organism", "chrom").agg(F.max("_k").alias("_k"))
    return out.join(best, ["organism", "chrom", "_k"]).drop("_k")


def proteins(spark: SparkSession, path: str) -> DataFrame:
    """(alignment, seq_id, organism, defline, residues) of alignment files, one file an alignment, named by the file."""
    file = F.input_file_name()
    raw = spark.read.text(local_path(spark, path), wholetext=True).select(S.alignment_name(file).alias("alignment"), "value")
    parts = F.filter(F.split(F.concat(F.lit("\n"), F.regexp_replace("value", "\r", "")), "\n>"), lambda x: F.trim(x, F.lit(" \t\n")) != "")
    rows = raw.select("alignment", F.posexplode(parts).alias("seq_idx", "part"))
    # What stands before the first record is a comment.
    rows = rows.where(~F.col("part").startswith("\n;"))
    lines = F.split("part", "\n")
    body = F.array_join(F.filter(F.transform(F.slice(lines, F.lit(2), F.size(lines)), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith(";")), "")
    defline = F.trim(F.get(lines, 0))
    return rows.select("alignment", "seq_idx", S.ident(defline).alias("seq_id"), S.tag(defline, "organism").alias("organism"), defline.alias("defline"), body.alias("residues"))
