"""Tables, the shared folder, and small helpers that every operator uses."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "exonia", master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings this library expects; used by the commands, bench and tests."""
    b = SparkSession.builder.appName(app).master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return b.config(map=defaults | conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def few(df: DataFrame, column: str, most: int = 1000) -> list:
    """A column's values on the driver, in the rows' order; an error if there are more than `most`."""
    rows = df.select(column).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows of {column}")
    return [r[0] for r in rows]


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session. Where that is unset and all tasks run in this
    process (tests, one machine) a new temporary folder, which is then kept in the session; elsewhere an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.exonia.shared", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="exonia-")
        spark.conf.set("spark.exonia.shared", folder)
    return folder


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def stored(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """df written once as Parquet, with these options, in the shared folder and read again: cuts the lineage and outlives lost executors.

    The folder is removed by discard(), at the latest when the driver's JVM ends."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(folder)
    fs, path = _path(spark, folder)
    fs.deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(folder)
    out._stored_in = folder
    return out


def discard(df: DataFrame) -> None:
    """Removes the folder of a stored table that nothing reads any more."""
    fs, path = _path(df.sparkSession, df._stored_in)
    fs.delete(path, True)


def same(left: DataFrame, right: DataFrame, keys: list[str], prefix: str = "r_") -> tuple[DataFrame, Column]:
    """right with its keys renamed, and the null-safe equality of the keys."""
    right = right.withColumnsRenamed({k: prefix + k for k in keys})
    return right, reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[prefix + k]) for k in keys))


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other; the keys come out once."""
    other, cond = same(left, right, keys)
    return left.join(other, cond, how).drop(*(f"r_{k}" for k in keys))


def spread(df: DataFrame) -> DataFrame:
    """df, with its rows moved to other tasks only where it has fewer splits than there are cores, as one small file has. How many
    tasks is left to adaptive execution, which goes by the bytes."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.hint("rebalance") if df.rdd.getNumPartitions() < n else df


def evaluated(df: DataFrame, **columns: Column) -> DataFrame:
    """df with new columns that are computed once a row, however often later expressions use them: the optimizer doesn't
    copy expressions through a generator."""
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def digits(col: str | Column) -> Column:
    """The runs of ASCII digits of a string, in order; null for null."""
    return F.regexp_extract_all(col, F.lit("[0-9]+"), F.lit(0))
