"""Problem 4: references to records that don't exist, were deleted or arrive later.

Method: references and parent keys are partitioned alike and sorted by time, and one linear pass over both streams (a
running maximum) tells from the parents' validity intervals whether a reference is live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exonia.session import join_null_safe

#: Withdrawal time of a parent that is still there; later than any reference.
NEVER = "9999-12-31 23:59:59"
#: References of one key and day that a task takes before they are spread over several.
SPREAD_ROWS = 200_000


def unresolved(refs: DataFrame, parents: DataFrame, keys: list[str], spread_rows: int = SPREAD_ROWS) -> DataFrame:
    """References without a live parent, as refs' columns and `kind`.

    refs has the keys, `at` (timestamp_ntz) and other columns; parents has the keys, `loaded_at` and `withdrawn_at`.
    A parent is live at t if loaded_at <= t and (withdrawn_at is null or t < withdrawn_at). kind is `missing` if no
    parent has the key, `deleted` if one was loaded by then, otherwise `late`. A null key part equals no parent. A parent
    whose loaded_at is null was never loaded; a reference whose `at` is null is `missing` where there is no parent and
    otherwise not judged. Repeated references come out as often as they are there.

    Keys are cut by day, so that neither a hot key's references nor its parents meet in one task; parents of one
    instant are combined first, days with very many references are spread further, with their parents repeated."""
    rest = [c for c in refs.columns if c not in keys]
    day = F.coalesce(F.expr("unix_date(cast({0} as date))".format("at")), F.lit(-(1 << 30)))
    children = refs.select(*keys, "at", F.struct(*rest).alias("_row")).withColumn("_day", day)
    targets = (
        parents.where(" and ".join(f"{k} is not null" for k in keys))
        .select(*keys, F.col("loaded_at").alias("at"), F.coalesce("withdrawn_at", F.lit(NEVER).cast("timestamp_ntz")).alias("_until"))
        .groupBy(*keys, "at")
        .agg(F.max("_until").alias("_until"))
        .withColumn("_day", F.coalesce(F.expr("unix_date(cast(at as date))"), F.lit(1 << 30)))
    )
    n_refs = refs.count()
    # Groups above the limit are at most 256, so the list of their sizes may be broadcast.
    limit = max(spread_rows, n_refs // 256)
    parts = F.when(F.col("_n") > limit, F.ceil(F.col("_n") / spread_rows)).otherwise(1).cast("int").alias("_parts")
    # One row a key and day: what earlier days leave behind, and whether the key has any parent.
    none = F.lit(None).cast("timestamp_ntz")
    per_key = Window.partitionBy(*keys)
    earlier = per_key.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = (
        children.select(*keys, "_day", F.lit(1).alias("_n"), none.alias("_until"))
        .unionByName(targets.select(*keys, "_day", F.lit(0).alias("_n"), "_until"))
        .groupBy(*keys, "_day")
        .agg(F.sum("_n").alias("_n"), F.max("_until").alias("_until"))
        .withColumns({"_carry": F.max("_until").over(earlier), "_any": F.max("_until").over(per_key).isNotNull()})
        .where(F.col("_n") > 0)
        .select(*keys, "_day", "_carry", "_any", parts)
    )
    spread: Column = F.lit(0)
    if n_refs > spread_rows:
        hot = children.groupBy(*keys, "_day").agg(F.count("*").alias("_n")).where(F.col("_n") > limit)
        children = join_null_safe(children, F.broadcast(hot.select(*keys, "_day", parts)), [*keys, "_day"], "left")
        spread = F.coalesce(F.pmod(F.xxhash64("_row"), F.col("_parts")).cast("int"), F.lit(0))
    heads = days.withColumn("_part", F.explode(F.expr("sequence(0, _parts - 1)")))
    held = join_null_safe(targets, days.select(*keys, "_day", "_parts"), [*keys, "_day"]).withColumn("_part", F.explode(F.expr("sequence(0, _parts - 1)")))
    nothing = F.lit(None).cast(refs.select(F.struct(*rest).alias("x")).schema["x"].dataType)
    stream = (
        children.select(*keys, "_day", spread.alias("_part"), "at", F.lit(2).alias("_kind"), none.alias("_until"), F.lit(None).cast("boolean").alias("_any"), "_row")
        .unionByName(held.select(*keys, "_day", "_part", "at", F.lit(1).alias("_kind"), "_until", F.lit(None).cast("boolean").alias("_any"), nothing.alias("_row")))
        .unionByName(heads.select(*keys, "_day", "_part", none.alias("at"), F.lit(0).alias("_kind"), F.col("_carry").alias("_until"), "_any", nothing.alias("_row")))
    )
    merge = Window.partitionBy(*keys, "_day", "_part").orderBy(F.col("at").asc_nulls_first(), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    judged = stream.withColumns({"_seen": F.max("_until").over(merge), "_exists": F.max("_any").over(merge)}).where("_kind = 2")
    return (
        judged.withColumn("kind", F.when(~F.col("_exists"), "missing").when(F.col("at").isNull(), None).when(F.col("_seen").isNull(), "late").when(F.col("_seen") <= F.col("at"), "deleted"))
        .where(F.col("kind").isNotNull())
        .select(*keys, "_row.*", "kind")
        .select(*refs.columns, "kind")
    )


def orphans(gff: DataFrame, contig: DataFrame, protein_sequence: DataFrame, genepred: DataFrame) -> DataFrame:
    """(tbl, row_id, load_month, kind) of the rows of gff and protein_sequence whose reference isn't live when they load.

    Null and blank references are no cases. A protein without organism refers by seq_id alone: its parents are those of
    any organism. load_month is null where loaded_at is."""
    keys = ["_scope", "_name"]
    def prepare(df, scope, name, tbl):
        return df.select(scope.alias("_scope"), name.alias("_name"), F.col("loaded_at").alias("at"), F.lit(tbl).alias("tbl"), "row_id").where(F.trim(F.col("_name")) != "")
    def parent(df, scope, name):
        return df.select(scope.alias("_scope"), F.col(name).alias("_name"), "loaded_at", "withdrawn_at")
    own = lambda c: F.concat(F.lit("="), c)  # noqa: E731 - so that no organism's name is that of the scope of all
    anywhere = F.lit("*")
    lines = prepare(gff, own(F.col("organism")), F.trim(F.col("gff_seqid")), "gff")
    members = prepare(protein_sequence, F.coalesce(own(F.col("organism")), anywhere), F.col("seq_id"), "protein_sequence")
    models = genepred.select("accno", "loaded_at", "withdrawn_at", F.explode(F.array(own(F.col("organism")), anywhere)).alias("_org"))
    found = unresolved(lines, parent(contig, own(F.col("organism")), "chrom"), keys).unionByName(
        unresolved(members, parent(models, F.col("_org"), "accno"), keys)
    )
    return found.select("tbl", "row_id", F.substring(F.col("at").cast("string"), 1, 7).alias("load_month"), "kind")
