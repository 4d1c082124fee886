"""Problem 5: several values packed in one field.

Method: for each source the delimiter is inferred by scoring the candidates on how even their piece counts are over its
fields and how regular the pieces are; fields are split by it and exploded with position. Fields that the source's delimiter
doesn't cut into regular pieces only are of other hands: for these the delimiter is inferred again, for each source and set
of marks that the fields hold. Nothing else reads a field, so a wrong delimiter gives wrong rows."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exonia.session import discard, evaluated, join_null_safe, spread, stored

#: Most sources whose inferred delimiters are sent to all tasks; more of them are joined by shuffling.
SENT_SOURCES = 4096
WS = r"[ \t\r\n]"
BLANK = " \t\r\n"
#: What may surround a number.
DRESSING = BLANK + "\"'{}[]()"


def piece_pattern(marks: str) -> str:
    """One attribute piece: key, white space, at most one `=`, white space, value, with the white space after it. A value
    that begins with a quote runs to the next one, and the piece to the next of the marks after that; one that is never
    closed runs to the end. Groups: 1 key, 2 and 3 the quoted value, 4 an unclosed one, 5 the plain one."""
    key = rf"([^ \t\r\n={marks}]*+)"
    rest = rf"[^{marks}]*+"
    value = rf"(?:\"([^\"]*+)\"{rest}|'([^']*+)'{rest}|[\"']([\s\S]*+)|([^{marks}]*+))"
    return rf"(?=[^ \t\r\n{marks}]){key}{WS}*+=?+{WS}*+{value}"


@dataclass(frozen=True)
class Candidate:
    """A delimiter: what parts two pieces, what is dropped from a field's ends (nothing: empty pieces are dropped instead), one
    regular piece with the delimiter behind it, and, where quotes protect delimiters, a piece of a field that has quotes."""

    name: str
    between: str
    ends: str
    regular: str
    quoted: str | None = None

    def pieces(self, field: Column) -> Column:
        """The pieces of a field, without white space before them; blank ones don't count."""
        if not self.ends:
            return F.array_remove(F.split(field, self.between), "")
        bare = F.trim(field, F.lit(self.ends))
        plain = F.when(bare != "", F.split(bare, self.between)).otherwise(F.array().cast("array<string>"))
        if self.quoted is None:
            return plain
        return F.when(field.rlike("[\"']"), F.regexp_extract_all(field, F.lit(self.quoted), F.lit(0))).otherwise(plain)

    def explains(self, field: Column) -> Column:
        """Whether every piece is regular: what is left when regular pieces are taken away from the start is blank."""
        return F.trim(F.regexp_replace(field, self.regular, F.lit("")), F.lit(self.ends)) == ""


def _attributes(marks: str) -> Candidate:
    value = r"(?:\"[^\"]*+\"|'[^']*+'|[^ \t\r\n;|\"'][^;|\"]*+)"
    bare_value = r"(?:\"[^\"]*+\"|'[^']*+'|[^ \t\r\n=;|\"'][^;|\"]*+)"
    piece = rf"[^ \t\r\n=;|\"']++(?:{WS}*+={WS}*+{value}|{WS}++{bare_value}){WS}*+"
    return Candidate(marks, rf"[{marks}][ \t\r\n{marks}]*+", BLANK + marks, rf"\G[ \t\r\n{marks}]*+{piece}(?:[{marks}]|\z)", piece_pattern(marks))


def _numbers(mark: str) -> Candidate:
    dressing = "".join("\\" + c for c in DRESSING if c != mark)
    m = "\\" + mark
    return Candidate(mark, f"{m}[{dressing}{m}]*+", DRESSING + mark, rf"\G[{dressing}{m}]*+[0-9]++[{dressing}]*+(?:{m}|\z)")


@dataclass(frozen=True)
class Reading:
    """How fields of one kind are read: the candidate marks, and the widest delimiter, for fields that mix marks."""

    marks: tuple[Candidate, ...]
    widest: Candidate

    @property
    def candidates(self) -> tuple[Candidate, ...]:
        return (*self.marks, self.widest)

    def bit(self, mark: Column) -> Column:
        """The candidate's bit in a set of candidates; 0 for a mark that is none."""
        return F.coalesce(F.create_map(*(F.lit(x) for i, c in enumerate(self.candidates) for x in (c.name, 1 << i)))[mark], F.lit(0))

    def style(self, field: Column) -> Column:
        """Which of the marks a field holds, as an int."""
        return reduce(lambda a, b: a + b, (F.when(F.contains(field, F.lit(m.name)), 1 << i).otherwise(0) for i, m in enumerate(self.marks)))


NUMBERS = Reading(tuple(map(_numbers, (",", ";", "|", "/", "\t", " "))), Candidate("other", "[^0-9]++", "", r"[^0-9]*+[0-9]++[^0-9]*+|\G[^0-9]++"))
ATTRIBUTES = Reading((_attributes(";"), _attributes("|")), _attributes(";|"))


def cells(df: DataFrame, source: list[str], field: str, reading: Reading) -> DataFrame:
    """(source..., _style, _good, mark, fields, n, nn): the one pass over all fields. Those of one source that hold the same marks and
    are explained by the same candidates (bits of _good) are counted together, with the sums of each candidate's piece counts
    and of their squares, combined before they are shuffled. Null fields don't count."""
    text = F.col("_field")
    rows = df.where(F.col(field).isNotNull()).select(*source, F.col(field).alias("_field"))
    good = reduce(lambda a, b: a + b, (F.when(c.explains(text), 1 << i).otherwise(0) for i, c in enumerate(reading.candidates)))
    sizes = {f"_n{i}": F.size(c.pieces(text)).cast("bigint") for i, c in enumerate(reading.candidates)}
    rows = rows.select(*source, reading.style(text).alias("_style"), good.alias("_good"), *(n.alias(name) for name, n in sizes.items()))
    sums = (x for name in sizes for x in (F.sum(name).alias(name), F.sum(F.col(name) * F.col(name)).alias(f"_n{name}")))
    whole = rows.groupBy(*source, "_style", "_good").agg(F.count("*").alias("fields"), *sums)
    each = F.array(*(F.struct(F.lit(c.name).alias("mark"), F.col(name).alias("n"), F.col(f"_n{name}").alias("nn")) for c, name in zip(reading.candidates, sizes, strict=True)))
    return whole.select(*source, "_style", "_good", "fields", F.inline(each))


def scores(counted: DataFrame, source: list[str], reading: Reading) -> DataFrame:
    """(source..., mark, fields, consistency, regularity, score) of cells: how well each candidate cuts the fields of each source.

    regularity is the share of fields whose pieces all look like one value. consistency is 1 / (1 + spread) of the numbers
    of pieces, where spread is their standard deviation over their mean, times 1 less the share of the fields that the mark
    doesn't cut though another one does."""
    bits = reading.bit(F.col("mark"))
    cuts = (F.col("_style") == 0) | (F.col("mark") == reading.widest.name) | (F.col("_style").bitwiseAND(bits) > 0)
    share = lambda which: F.coalesce(F.sum(F.when(which, F.col("fields"))), F.lit(0)) / F.sum("fields")
    mean = F.sum("n") / F.sum("fields")
    spread = F.coalesce(F.try_divide(F.sqrt(F.greatest(F.lit(0.0), F.sum("nn") / F.sum("fields") - mean * mean)), mean), F.lit(0.0))
    return (
        counted.groupBy(*source, "mark")
        .agg(F.sum("fields").alias("fields"), (share(cuts) / (1 + spread)).alias("consistency"), share(F.col("_good").bitwiseAND(bits) > 0).alias("regularity"))
        .withColumn("score", F.col("consistency") * F.col("regularity"))
    )


def inferred(counted: DataFrame, source: list[str], reading: Reading, mixed: bool = False) -> DataFrame:
    """(source..., mark): the mark with the best score; the earlier one wins a tie.

    mixed: the widest delimiter is a candidate too, and a mark comes before it only if it explains all fields; of those that
    do, the one with the most even piece counts is chosen."""
    place = F.create_map(*(F.lit(x) for i, c in enumerate(reading.candidates) for x in (c.name, -i)))[F.col("mark")]
    widest = F.col("mark") == reading.widest.name
    if mixed:
        order = F.struct("regularity", F.when(F.col("regularity") == 1, F.col("consistency")).otherwise(widest.cast("double")), place)
    else:
        counted, order = counted.where(~widest), F.struct("score", place)
    return scores(counted, source, reading).groupBy(*source).agg(F.max_by("mark", order).alias("mark"))


def delimiters(counted: DataFrame, source: list[str], reading: Reading) -> DataFrame:
    """(source..., _style, mark, own) of cells: for each source and set of marks the source's delimiter, and the one of those fields
    that it doesn't explain (null if there are none)."""
    first = join_null_safe(counted, inferred(counted, source, reading).withColumnRenamed("mark", "_first"), source, "left")
    left = first.where(F.col("_good").bitwiseAND(reading.bit(F.col("_first"))) == 0)
    own = inferred(left, [*source, "_style"], reading, mixed=True).withColumnRenamed("mark", "own")
    styles = first.groupBy(*source, "_style").agg(F.first("_first").alias("mark"))
    return join_null_safe(styles, own, [*source, "_style"], "left")


def _by_mark(reading: Reading, mark: str, of, unknown: Column) -> Column:
    """What `of` gives for the row's delimiter."""
    known, name = reading.candidates, F.col(mark)
    return reduce(lambda e, c: e.when(name == c.name, of(c)), known[1:], F.when(name == known[0].name, of(known[0]))).otherwise(unknown)


def with_marks(df: DataFrame, source: list[str], field: str, reading: Reading) -> DataFrame:
    """df with `_mark`, the delimiter that its field is split by, and `_own`: whether that isn't the source's. Null fields are
    left out. Delimiters are sent to all tasks only after their number was found to be at most SENT_SOURCES."""
    text = F.col(field)
    rows = df.where(text.isNotNull())
    counted = stored(cells(rows, source, field, reading), "cells")
    marks = delimiters(counted, source, reading)
    few = marks.limit(SENT_SOURCES + 1).collect()
    if len(few) <= SENT_SOURCES:
        discard(counted)
        marks = F.broadcast(df.sparkSession.createDataFrame(few, marks.schema))
    both = join_null_safe(rows.withColumn("_style", reading.style(text)), marks.withColumnRenamed("mark", "_mark"), [*source, "_style"], "left")
    both = evaluated(both, _own=~_by_mark(reading, "_mark", lambda c: c.explains(text), F.lit(False)))
    return both.withColumn("_mark", F.when(F.col("_own"), F.col("own")).otherwise(F.col("_mark"))).drop("own", "_style")


def _items(df: DataFrame, keep: list[str], field: str, source: list[str], reading: Reading) -> DataFrame:
    """(keep..., _own, _pos, _piece): the pieces of the fields."""
    # Without a source all fields are of one.
    named = {f"_src_{c}": F.col(c) for c in source} or {"_src": F.lit(0)}
    rows = with_marks(spread(df.select(*keep, *(c.alias(n) for n, c in named.items()), F.col(field).alias("_field"))), list(named), "_field", reading)
    text = F.col("_field")
    return rows.select(*keep, "_own", F.posexplode(_by_mark(reading, "_mark", lambda c: c.pieces(text), F.array(text))).alias("_pos", "_piece"))


def attribute_items(df: DataFrame, keep: list[str], attr: str, source: list[str]) -> DataFrame:
    """(keep..., pos, tag, item): the pieces of an attribute field in order, counted from 1; keep mustn't have those names.

    Fields are split by the delimiter inferred for their source, or for its fields in their style. Null fields and fields of
    white space and marks give no rows, pieces without value an empty item, repeated pieces a row each. A field of any length
    is read in linear time."""
    blank, piece = F.lit(BLANK), F.col("_piece")
    rows = _items(df, keep, attr, source, ATTRIBUTES)
    rows = rows.withColumn("tag", F.substring_index(F.translate(piece, BLANK, "=" * len(BLANK)), "=", 1))
    rest = F.ltrim(F.substr(piece, F.length("tag") + 1), blank)
    rest = F.ltrim(F.when(F.startswith(rest, F.lit("=")), F.substr(rest, F.lit(2))).otherwise(rest), blank)
    rows = rows.withColumn("_rest", rest)
    rest, first = F.col("_rest"), F.left("_rest", F.lit(1))
    close = F.expr("locate(left(_rest, 1), _rest, 2)")
    item = F.when(~first.isin('"', "'"), F.rtrim(rest, blank)).when(close > 0, F.substr(rest, F.lit(2), close - 2)).otherwise(F.rtrim(F.substr(rest, F.lit(2)), blank))
    return rows.select(*keep, (F.col("_pos") + 1).alias("pos"), "tag", item.alias("item"))


def number_items(df: DataFrame, keep: list[str], field: str, source: list[str]) -> DataFrame:
    """(keep..., pos, item): the numbers of a packed list in order, counted from 1, as their digits.

    Lists are split by the delimiter inferred for their source, or for its lists in their style; brackets, quotes and blanks
    around a number are dropped. Null and empty lists give no rows."""
    rows = _items(df, keep, field, source, NUMBERS).withColumn("item", F.translate("_piece", DRESSING, ""))
    return rows.select(*keep, (F.col("_pos") + 1).alias("pos"), "item")


def unpacked(gff: DataFrame, genepred: DataFrame) -> DataFrame:
    """(tbl, row_id, pos, tag, item) for gff_attr of gff and exonstarts of genepred, whose delimiters are inferred at the same time."""
    with ThreadPoolExecutor(2) as at_once:
        attributes = at_once.submit(attribute_items, gff, ["row_id"], "gff_attr", ["organism", "dialect"])
        starts = at_once.submit(number_items, genepred, ["row_id"], "exonstarts", ["organism"])
    return (
        attributes.result()
        .select(F.lit("gff").alias("tbl"), "row_id", "pos", "tag", "item")
        .unionByName(starts.result().select(F.lit("genepred").alias("tbl"), "row_id", "pos", F.lit("").alias("tag"), "item"))
    )
