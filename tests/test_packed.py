"""Problem 5 against a scanner that reads character by character."""

import random

from exonia.operators import packed

WS = " \t\r\n"


def scan(field):
    out, i = [], 0
    while i < len(field):
        if field[i] in WS + ";|":
            i += 1
            continue
        j = i
        while j < len(field) and field[j] not in WS + "=;|":
            j += 1
        key, i = field[i:j], j
        while i < len(field) and field[i] in WS:
            i += 1
        if i < len(field) and field[i] == "=":
            i += 1
            while i < len(field) and field[i] in WS:
                i += 1
        if i < len(field) and field[i] in "\"'":
            end = field.find(field[i], i + 1)
            if end < 0:
                out.append((key, field[i + 1 :].rstrip(WS)))
                break
            value, i = field[i + 1 : end], end + 1
            while i < len(field) and field[i] not in ";|":
                i += 1
        else:
            j = i
            while j < len(field) and field[j] not in ";|":
                j += 1
            value, i = field[i:j].rstrip(WS), j
        out.append((key, value))
    return out


def test_random_attributes(spark):
    r = random.Random(5)
    alphabet = ["a", "ID", "x1", "=", ";", ";", "|", '"', "'", " ", "\t", ",", "é", "\r\n"]
    fields = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 16))) for _ in range(1500)]
    fields += ["", " ", ";;", None, 'gene_id "a; b|c"; n 1', "ID=a|Parent=b", 'x="a|b";y=c', "a=b;a=b", "a=" + "q" * 100000]
    df = spark.createDataFrame([(i, f, r.choice(["o", None]), 5, "t") for i, f in enumerate(fields)], "row_id int, gff_attr string, organism string, pos int, item string")
    got = {}
    for x in packed.attribute_items(df, ["row_id"], "gff_attr", ["organism"]).collect():
        got.setdefault(x.row_id, []).append((x.pos, x.tag, x.item))
    for i, f in enumerate(fields):
        assert [(t, v) for _, t, v in sorted(got.get(i, []))] == scan(f or ""), repr(f)
        assert [p for p, _, _ in sorted(got.get(i, []))] == list(range(1, len(scan(f or "")) + 1))
    assert packed.attribute_items(df.limit(0), ["row_id"], "gff_attr", ["organism"]).collect() == []


def test_numbers_in_every_notation(spark):
    fields = ["1,2,3", "1,2,3,", ",1,,2", '"1","2"', '1","2', "'7' '8'", "[1, 2]", "{1;2}", "1 2\t3", "1/2", "1|2", " 1 , 2 ", "", None, "none", "12x34,5", "1;2,3", "٣,4"]
    df = spark.createDataFrame([(i, f, 1) for i, f in enumerate(fields)], "row_id int, exonstarts string, tag int")
    import re

    got = {}
    for x in packed.number_items(df, ["row_id"], "exonstarts", []).collect():
        got.setdefault(x.row_id, []).append((x.pos, x.item))
    for i, f in enumerate(fields):
        assert sorted(got.get(i, [])) == list(enumerate(re.findall("[0-9]+", f or ""), 1)), f


def chosen(df, reading):
    return {x.s: x.mark for x in packed.inferred(packed.cells(df, ["s"], "f", reading), ["s"], reading).collect()}


def test_inferred_delimiters(spark):
    df = spark.createDataFrame([("a", "1;2;3"), ("a", "4;5"), ("a", "6"), ("b", "1, 2"), ("b", "3, 4, 5"), ("c", None)], "s string, f string")
    assert chosen(df, packed.NUMBERS) == {"a": ";", "b": ","}


def test_even_piece_counts_decide(spark):
    # Half of the fields are regular by either mark; only the numbers of pieces tell them apart: always 3 by |, 2 to 6 by ;.
    fields = ["a=1;b=2", "a=1;b=2;c=3;d=4;e=5;f=6", "a=1|b=2|c=3", "d=4|e=5|f=6"]
    df = spark.createDataFrame([(1, f) for f in fields], "s int, f string")
    got = {x.mark: x for x in packed.scores(packed.cells(df, ["s"], "f", packed.ATTRIBUTES), ["s"], packed.ATTRIBUTES).collect()}
    assert got[";"].regularity == got["|"].regularity == 0.5
    assert got["|"].consistency > got[";"].consistency
    assert chosen(df, packed.ATTRIBUTES) == {1: "|"}


def items(df):
    got = {}
    for x in packed.attribute_items(df, ["row_id"], "f", ["s"]).collect():
        got.setdefault(x.row_id, []).append((x.pos, x.tag, x.item))
    return {i: [x[1:] for x in sorted(v)] for i, v in got.items()}


FIELDS = [*["a=1;b=2"] * 6, "a=1;b=2;c=3", "a=1|b=2", 'a="x|y"|b=2', "a='x|b=2", "a=1;b=2|c=3", " | a = 1 | ", "a='x'|b='y", "a=1;;b=2;"]


def test_fields_of_other_hands_have_their_own_delimiter(spark):
    df = spark.createDataFrame([(i, f, 1) for i, f in enumerate(FIELDS)], "row_id int, f string, s int")
    assert items(df) == {i: scan(f) for i, f in enumerate(FIELDS)}
    marks = {(x._style, x.mark, x.own) for x in packed.delimiters(packed.cells(df, ["s"], "f", packed.ATTRIBUTES), ["s"], packed.ATTRIBUTES).collect()}
    assert marks == {(1, ";", None), (2, ";", ";|"), (3, ";", ";|")}


def test_a_wrong_delimiter_gives_wrong_rows(spark, monkeypatch):
    df = spark.createDataFrame([(i, f, 1) for i, f in enumerate(FIELDS)], "row_id int, f string, s int")
    right, real = items(df), packed.inferred
    for wrong in ("|", "#"):
        monkeypatch.setattr(packed, "inferred", lambda *args, wrong=wrong, **more: real(*args, **more).withColumn("mark", packed.F.lit(wrong)))
        assert items(df) != right
    numbers = spark.createDataFrame([(1, "1,2"), (2, "3;4")], "row_id int, f string")
    assert [x.item for x in packed.number_items(numbers, ["row_id"], "f", []).collect()] == ["1,2", "3;4"]


def test_very_long_fields(spark):
    fields = [";".join(f"k{i}=v" for i in range(50_000)), "a=" + " " * 60_000 + ";b=2", "'" * 20_001]
    df = spark.createDataFrame([(i, f, i) for i, f in enumerate(fields)], "row_id int, f string, s int")
    got = items(df)
    assert len(got[0]) == 50_000 and got[1] == [("a", ""), ("b", "2")] and len(got[2]) == 1


def test_many_sources_are_joined(spark, monkeypatch):
    monkeypatch.setattr(packed, "SENT_SOURCES", 3)
    df = spark.createDataFrame([(i, f"{i}{'|;'[i % 2]}x=2", str(i)) for i in range(20)], "row_id int, f string, s string")
    assert packed.attribute_items(df, ["row_id"], "f", ["s"]).count() == 40
