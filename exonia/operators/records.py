"""Problem 1: rows that fail to parse.

Method: an error-recovering recursive-descent grammar of annotation records, over runs of lines. Each rule reads what it
can, notes errors with their place, and goes on; after a broken quote reading resumes at the next validated anchor: within a
record at the next piece that starts like an attribute, in the run at the next line that starts like a record. Lines passed
over on the way are judged again, as records of their own."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exonia.session import stored

WHITE = " \t\r\n"
#: The identifier's key in each dialect, the strands, and the reasons in the order in which they count.
IDENTIFIER = {"gff3": "ID", "gtf": "transcript_id", "jgi": "proteinId"}
STRANDS = ("+", "-", ".")
REASONS = ("columns", "quoting", "value")
UNCLOSED, PASSED_OVER = "quote isn't closed", "after a quote that isn't closed"
#: Lines of a file that are put in order at once.
BLOCK_LINES = 1 << 16

_SEQID = re.compile(r"(?:[A-Za-z0-9.:^*$@!+_?|-]|%[0-9A-Fa-f]{2})+")
#: ASCII numbers; integers of up to 18 digits.
_INTEGER, _REAL = re.compile(r"[-+]?[0-9]{1,18}"), re.compile(r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?")
_KEY = re.compile(r"[^ \t\r\n=;|]*")
_EQUALS = re.compile(r"[ \t\r\n]*=?[ \t\r\n]*")
_BETWEEN = re.compile(r"[ \t\r\n;|]*")
_PLAIN = re.compile(r"[^;|]*")
_PIECE_ANCHOR = re.compile(r"[;|][ \t\r\n]*(?=[A-Za-z_][A-Za-z0-9_.]*(?:[ \t]*=|[ \t]+[\"'A-Za-z0-9_]))")
_RECORD_ANCHOR = re.compile(r"[^\t\n]+\t[^\t\n]*\t[^\t\n]*\t[ ]*[0-9]+[ ]*\t[ ]*[0-9]+[ ]*\t[^\t\n]*\t[ ]*[-+.][ ]*\t[^\t\n]*\t")


class Fault(NamedTuple):
    reason: str
    column: int  # 1 to 9; 0: the whole record
    offset: int  # characters from the start of the record
    message: str


class Record(NamedTuple):
    columns: list[str]
    attributes: list[tuple[str, str]]
    faults: list[Fault]


def read_record(text: str, dialect: str | None) -> Record:
    """record := column (TAB column){8}; the ninth is read by attributes, columns 1 and 7 are judged."""
    faults: list[Fault] = []
    columns = text.split("\t")
    if len(columns) != 9:
        return Record(columns, [], [Fault("columns", 0, 0, f"{len(columns)} columns")])
    start = len(text) - len(columns[8])
    pieces = read_attributes(text, start, faults)
    if columns[6].strip(" ") not in STRANDS:
        faults.append(Fault("value", 7, sum(map(len, columns[:6])) + 6, "strand"))
    if not _SEQID.fullmatch(columns[0].strip(" ")):
        faults.append(Fault("value", 1, 0, "seqid"))
    name = IDENTIFIER.get(dialect or "")
    if not any(key == name for key, _ in pieces):
        faults.append(Fault("value", 9, start, "no identifier"))
    return Record(columns, pieces, faults)


def read_attributes(text: str, at: int, faults: list[Fault]) -> list[tuple[str, str]]:
    """attributes := piece ((";" | "|") piece)*"""
    pieces: list[tuple[str, str]] = []
    at = _BETWEEN.match(text, at).end()
    while at < len(text):
        key, value, at = read_piece(text, at, faults)
        pieces.append((key, value))
        at = _BETWEEN.match(text, at).end()
    return pieces


def read_piece(text: str, at: int, faults: list[Fault]) -> tuple[str, str, int]:
    """piece := key WS* "="? WS* value"""
    key = _KEY.match(text, at).group()
    if '"' in key:
        faults.append(Fault("quoting", 9, at, "quote in a key"))
    if not key:
        faults.append(Fault("value", 9, at, "empty key"))
    begin = _EQUALS.match(text, at + len(key)).end()
    if text[begin : begin + 1] in ('"', "'"):
        value, end = read_quoted(text, begin, faults)
    else:
        value = _PLAIN.match(text, begin).group()
        end = begin + len(value)
        value = value.rstrip(WHITE)
        if '"' in value:
            faults.append(Fault("quoting", 9, begin + value.index('"'), "quote in a value"))
    if not value:
        faults.append(Fault("value", 9, begin, "empty value"))
    return key, value, end


def read_quoted(text: str, at: int, faults: list[Fault]) -> tuple[str, int]:
    """quoted := MARK (any but MARK)* MARK WS*, up to the end of the piece; resumes at a piece's anchor where it is broken."""
    close = text.find(text[at], at + 1)
    if close < 0:
        faults.append(Fault("quoting", 9, at, UNCLOSED))
        anchor = _PIECE_ANCHOR.search(text, at)
        end = anchor.start() if anchor else len(text)
        return text[at + 1 : end].rstrip(WHITE), end
    after = _PLAIN.match(text, close + 1).group()
    if after.strip(WHITE):
        faults.append(Fault("quoting", 9, close + 1, "text after a closing quote"))
    return text[at + 1 : close], close + 1 + len(after)


def read_line(line: str | None, dialect: str | None) -> Record | None:
    """One line as a record; None for null, blank and comment lines."""
    text = (line or "").strip(WHITE)
    return None if not text or text[0] == "#" else read_record(text, dialect)


def is_broken(record: Record | None) -> bool:
    return record is not None and any(f.message == UNCLOSED for f in record.faults)


def resumes(line: str) -> bool:
    """Whether reading goes on at a line after a broken quote: a blank one, a comment or a validated record start."""
    text = line.lstrip(WHITE)
    return not text or text[0] == "#" or bool(_RECORD_ANCHOR.match(text))


def read_lines(lines: list[str | None], dialect: str | None) -> Iterator[tuple[int, Record, int | None]]:
    """(number of the line, record, number of the broken record's line) of a run of lines, read as one text.

    Where a record's quote is broken, reading goes on at the next validated record start, comment or blank line. The lines
    passed over on the way are then judged again as records of their own; they say which line was broken."""
    i = 0
    while i < len(lines):
        record = read_line(lines[i], dialect)
        if record is not None:
            yield i, record, None
        at = i + 1
        if is_broken(record):
            while at < len(lines) and not resumes(lines[at] or ""):
                at += 1
            for j in range(i + 1, at):
                yield j, read_line(lines[j], dialect), i
        i = at


def runs(*keys: list) -> Iterator[tuple[int, int]]:
    """The ranges of neighbours that are equal in all lists."""
    at = 0
    for _, own in groupby(zip(*keys, strict=True)):
        n = sum(1 for _ in own)
        yield at, at + n
        at += n


ATTRIBUTES = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))
FAULTS = pa.list_(pa.struct([("reason", pa.string()), ("column", pa.int32()), ("offset", pa.int32()), ("message", pa.string())]))
PARSED = "seqid string, source string, type string, `start` bigint, `end` bigint, score double, strand string, phase int, attributes array<struct<key: string, value: string>>, reason string, faults array<struct<reason: string, `column`: int, `offset`: int, message: string>>"

PARSED_NAMES = ("seqid", "source", "type", "start", "end", "score", "strand", "phase", "attributes", "reason", "faults")


def _integer(text: str) -> int | None:
    return int(text) if _INTEGER.fullmatch(text) else None


def _real(text: str) -> float | None:
    return float(text) if _REAL.fullmatch(text) else None


def parsed_columns(records: list[Record]) -> list[pa.Array]:
    """The columns of PARSED. Typed values that can't be read are null: columns 2 to 6 and 8 aren't judged."""
    full = [r.columns if len(r.columns) == 9 else [None] * 9 for r in records]
    text = lambda i: pa.array([c[i] and c[i].strip(" ") for c in full], pa.string())
    number = lambda i, kind, to: pa.array([None if c[i] is None else kind(c[i].strip(" ")) for c in full], to)
    phase = lambda s: int(s) if s in ("0", "1", "2") else None
    reasons = [next((q for q in REASONS if any(f.reason == q for f in r.faults)), None) if r.faults else None for r in records]
    return [
        text(0), text(1), text(2), number(3, _integer, pa.int64()), number(4, _integer, pa.int64()),
        number(5, _real, pa.float64()), text(6), number(7, phase, pa.int32()),
        pa.array([[{"key": k, "value": v} for k, v in r.attributes] for r in records], ATTRIBUTES),
        pa.array(reasons, pa.string()),
        pa.array([[f._asdict() for f in r.faults] for r in records], FAULTS),
    ]


def parse_lines(df: DataFrame, line_id: str = "line_id", line: str = "line", dialect: str = "dialect", file: str | None = None) -> DataFrame:
    """One row per record: the id, the typed columns, `reason` (null: the record is valid) and all located `faults`, with
    offsets from the record's start.

    Neighbouring lines of one dialect (and file, if its column is named) are read as one text, by read_lines. Null, empty, blank
    and comment lines are no records. A line with several faults has the first of columns, quoting, value as its reason. A
    dialect that is null or unknown has no identifier, so its records fail by value. Repeated lines come out each. Of the
    table's columns only those named are read. Which lines are neighbours makes no difference to the rows."""

    def parse(batches):
        for b in batches:
            lines, kinds = b.column(1).to_pylist(), b.column(2).to_pylist()
            places, records = [], []
            for lo, hi in runs(kinds, *(c.to_pylist() for c in b.columns[3:])):
                for i, r, _ in read_lines(lines[lo:hi], kinds[lo]):
                    places.append(lo + i)
                    records.append(r)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(places, pa.int64())), *parsed_columns(records)], names)

    key = df.schema[line_id].dataType.simpleString()
    names = [line_id, *PARSED_NAMES]
    return df.select(line_id, line, dialect, *([file] if file else [])).mapInArrow(parse, f"{line_id} {key}, {PARSED}")


def parse_texts(df: DataFrame, text_id: str, text: str, dialect: str) -> DataFrame:
    """As parse_lines, for texts of many lines each, with `line_no` (from 1) of each record within its text and `broken_no`, the
    number of the line whose broken quote the record follows."""

    def parse(batches):
        for b in batches:
            ids, numbers, broken, records = [], [], [], []
            for i, body, kind in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                for n, r, after in read_lines((body or "").split("\n"), kind):
                    ids.append(i)
                    numbers.append(n + 1)
                    broken.append(None if after is None else after + 1)
                    records.append(r)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(numbers, pa.int32()), pa.array(broken, pa.int32()), *parsed_columns(records)], names)

    key = df.schema[text_id].dataType.simpleString()
    names = [text_id, "line_no", "broken_no", *PARSED_NAMES]
    return df.select(text_id, text, dialect).mapInArrow(parse, f"{text_id} {key}, line_no int, broken_no int, {PARSED}")


def resumed_lines(df: DataFrame, file: str = "file_name", line_no: str = "line_no", line_id: str = "line_id", line: str = "line", dialect: str = "dialect", block: int = BLOCK_LINES) -> DataFrame:
    """(id, file, number, faults, broken_no): the records among the lines of files, as read_lines reads a file's lines.

    A line after a broken quote, up to the next validated record start, comment or blank line of the same file, has the
    number of the broken record's line in broken_no and, before its own faults, one that says so; for others broken_no is
    null. A file's lines are ordered by number, then id, in blocks of line numbers, so that a file may have any size. A
    line without file or number follows no other one. Names that clash with these columns don't matter."""

    def parse(batches):
        for b in batches:
            kept: list[tuple] = []
            for text, kind in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                r = read_line(text, kind)
                broken, stop = is_broken(r), resumes(text or "")
                kept.append((r is not None, stop, True if broken else False if stop else None, [f._asdict() for f in r.faults] if r else []))
            columns = [pa.array(c, t) for c, t in zip(zip(*kept, strict=True) if kept else [()] * 4, (pa.bool_(), pa.bool_(), pa.bool_(), FAULTS), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *columns], ["_id", "_file", "_no", "_record", "_stop", "_event", "_faults"])

    kinds = [df.schema[c].dataType.simpleString() for c in (line_id, file, line_no)]
    fault = "struct<reason: string, `column`: int, `offset`: int, message: string>"
    rows = df.select(line_id, file, line_no, line, dialect).mapInArrow(parse, f"_id {kinds[0]}, _file {kinds[1]}, _no {kinds[2]}, _record boolean, _stop boolean, _event boolean, _faults array<{fault}>")
    rows = rows.withColumn("_block", F.expr(f"cast(_no as bigint) div {block}")).withColumn("_state", F.when(F.col("_event").isNotNull(), F.struct("_event", "_no")))
    # What can't be placed is a part of its own.
    placed = F.col("_file").isNotNull() & F.col("_no").isNotNull()
    rows = stored(rows.withColumn("_lone", F.when(~placed, F.col("_id"))), "lines")
    before = lambda *by: Window.partitionBy("_file", *by).rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct("_no", "_id")
    last = rows.where(placed).groupBy("_file", "_block").agg(F.max_by("_state", F.when(F.col("_event").isNotNull(), at)).alias("_last"))
    carried = last.select("_file", "_block", F.last("_last", ignorenulls=True).over(before().orderBy("_block")).alias("_carried"))
    held = rows.withColumn("_held", F.last("_state", ignorenulls=True).over(before("_block", "_lone").orderBy("_no", "_id")))
    every = held.join(carried, ["_file", "_block"], "left").withColumn("_held", F.coalesce(F.when(placed, F.col("_held")), "_carried"))
    broken_no = F.when(~F.col("_stop") & F.col("_held._event"), F.col("_held._no"))
    note = F.array(F.struct(F.lit("quoting").alias("reason"), F.lit(0).alias("column"), F.lit(0).alias("offset"), F.lit(PASSED_OVER).alias("message")).cast(fault))
    faults = F.when(broken_no.isNotNull(), F.concat(note, "_faults")).otherwise(F.col("_faults"))
    return every.where("_record").select(F.col("_id").alias(line_id), F.col("_file").alias(file), F.col("_no").alias(line_no), faults.alias("faults"), broken_no.alias("broken_no"))


def faulty(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNotNull())


def valid(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNull()).drop("reason", "faults")
