"""Problem 1 against a plain reading of the rules."""

import random
import re

from exonia.operators import records

GOOD = "chr1\tx\tCDS\t5\t10\t.\t+\t0\t"
CASES = [
    (None, "gff3", None), ("", "gff3", None), (" \t\r\n", "gff3", None), ("# a\tb", "gff3", None), ("  #x", "gff3", None),
    (GOOD + "ID=a", "gff3", "ok"), (" " + GOOD + "ID=a;\r\n", "gff3", "ok"), (GOOD + "ID=a\tb", "gff3", "columns"), ("x", "gff3", "columns"),
    (GOOD + 'ID="a;b"', "gff3", "ok"), (GOOD + 'ID="a', "gff3", "quoting"), (GOOD + "ID='a", "gff3", "quoting"), (GOOD + "ID=a'b", "gff3", "ok"),
    (GOOD + 'ID="a"b', "gff3", "quoting"), (GOOD + 'ID="a" ;x=1', "gff3", "ok"), (GOOD + 'ID=a"b', "gff3", "quoting"), (GOOD + 'I"D=a', "gff3", "quoting"),
    (GOOD + "ID=", "gff3", "value"), (GOOD + 'ID=""', "gff3", "value"), (GOOD + "=a;ID=b", "gff3", "value"), (GOOD + "ID==a", "gff3", "ok"), (GOOD + "id=a", "gff3", "value"),
    (GOOD + "transcript_id \"a\"; x 1", "gtf", "ok"), (GOOD + "ID=a", "gtf", "value"), (GOOD + "proteinId 3|", "jgi", "ok"), (GOOD + "ID=a", None, "value"), (GOOD + "ID=a", "odd", "value"),
    (GOOD.replace("+", " - ") + "ID=a", "gff3", "ok"), (GOOD.replace("+", "?") + "ID=a", "gff3", "value"), (GOOD.replace("+", "") + "ID=a", "gff3", "value"),
    (GOOD.replace("chr1", "chr%2Fa") + "ID=a", "gff3", "ok"), (GOOD.replace("chr1", "chr%2") + "ID=a", "gff3", "value"), (GOOD.replace("chr1", "chr 1") + "ID=a", "gff3", "value"),
    (GOOD.replace("chr1", "сhr") + "ID=a", "gff3", "value"), (GOOD.replace("chr1", "a\n") + "ID=a", "gff3", "value"), (GOOD + "", "gff3", "columns"), (GOOD + ";|ID=a;;|", "gff3", "ok"),
    (GOOD.replace("+", "?") + 'ID="a', "gff3", "quoting"), (GOOD + "ID =a", "gff3", "value"),
]


def expected(line, dialect):
    """The rules, read piece by piece with regular expressions."""
    ws = " \t\r\n"
    text = (line or "").strip(ws)
    if not text or text.startswith("#"):
        return None
    c = text.split("\t")
    if len(c) != 9:
        return "columns"
    pieces, rest = [], c[8]
    bad = False
    while rest := rest.lstrip(ws + ";|"):
        key = re.match(r"[^ \t\r\n=;|]*", rest).group()
        body = re.sub(r"^[ \t\r\n]*=?[ \t\r\n]*", "", rest[len(key) :], count=1)
        m = re.match(r"""(["'])(.*?)\1([^;|]*)""", body, re.S)
        if m:
            value, rest = m.group(2), body[m.end() :]
            bad |= bool(m.group(3).strip(ws))
        elif body[:1] in ("'", '"'):
            bad, value, rest = True, body[1:], ""
        else:
            value = re.match(r"[^;|]*", body).group()
            rest, value = body[len(value) :], value.rstrip(ws)
            bad |= '"' in value
        bad |= '"' in key
        pieces.append((key, value))
    if bad:
        return "quoting"
    name = {"gff3": "ID", "gtf": "transcript_id", "jgi": "proteinId"}.get(dialect, object())
    if c[6].strip(" ") not in ("+", "-", ".") or not re.fullmatch(r"(?:[A-Za-z0-9.:^*$@!+_?|-]|%[0-9A-Fa-f]{2})+", c[0].strip(" ")):
        return "value"
    if any(not k or not v for k, v in pieces) or name not in [k for k, _ in pieces]:
        return "value"
    return "ok"


def test_cases(spark):
    df = spark.createDataFrame([(i, line, d, "clash", "x") for i, (line, d, _) in enumerate(CASES)], "line_id long, line string, dialect string, reason string, `start` string")
    got = {r.line_id: r.reason or "ok" for r in records.parse_lines(df).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(CASES) if want}
    assert all(expected(line, d) == want for line, d, want in CASES)
    assert records.parse_lines(df.limit(0)).collect() == []


def test_random_lines():
    r = random.Random(7)
    alphabet = ["a", "ID", "=", ";", "|", '"', "'", " ", "\t", "\r", "x", "#", "%20", "é"]
    for _ in range(20000):
        line = "chr1\tx\tCDS\t1\t2\t.\t" + r.choice(["+", "-", ".", " + ", "*"]) + "\t.\t" + "".join(r.choice(alphabet) for _ in range(r.randint(0, 14)))
        record = records.read_line(line, "gff3")
        reason = None if record is None else next((q for q in records.REASONS if any(f.reason == q for f in record.faults)), "ok")
        assert reason == expected(line, "gff3"), line


def test_faults_are_located_and_reading_goes_on():
    line = GOOD + "ID='a; Parent=b; Note=\"c\" d; x="
    record = records.read_record(line, "gff3")
    assert ("Parent", "b") in record.attributes and ("Note", "c") in record.attributes
    offsets = {f.message: f.offset for f in record.faults}
    assert line[offsets["quote isn't closed"] :].startswith("'a; P")
    assert line[offsets["text after a closing quote"] :].startswith(" d;")
    assert {f.reason for f in record.faults} == {"quoting", "value"}


def test_texts_resume_at_record_starts(spark):
    text = "\n".join(["#head", GOOD + "ID=a", GOOD + "ID='b", "loose text", "more; of it", GOOD + "ID=c", "", GOOD + "ID=d"])
    df = spark.createDataFrame([(1, text, "gff3"), (2, None, "gff3"), (3, "", None)], "file long, body string, dialect string")
    got = sorted((r.line_no, r.reason, r.broken_no) for r in records.parse_texts(df, "file", "body", "dialect").collect())
    assert got == [(2, None, None), (3, "quoting", None), (4, "columns", 3), (5, "columns", 3), (6, None, None), (8, None, None)]


BROKEN = [GOOD + "ID='b", "x\ty", GOOD.replace("+", "?") + "ID=c", " " + GOOD.replace("5", "five") + "ID=d", GOOD + "ID=e"]


def test_lines_passed_over_are_judged_again():
    got = [(i, broken, [f.message for f in r.faults]) for i, r, broken in records.read_lines(["", *BROKEN], "gff3")]
    assert got == [(1, None, ["quote isn't closed"]), (2, 1, ["2 columns"]), (3, 1, ["strand"]), (4, 1, []), (5, None, [])]


def test_quotes_broken_over_lines_lose_no_line(spark):
    """Each line's reason is the same in whatever run it is read, and however many lines are passed over."""
    r = random.Random(3)
    lines = [(i, r.choice(BROKEN), r.choice(["gff3", "gtf"]), r.choice("ab")) for i in range(3000)]
    df = spark.createDataFrame(lines, "line_id long, line string, dialect string, file_name string")
    for file in (None, "file_name"):
        got = {x.line_id: x.reason or "ok" for x in records.parse_lines(df, file=file).collect()}
        assert got == {i: expected(x, d) for i, x, d, _ in lines}


def test_lines_of_files_resume_at_record_starts(spark):
    r = random.Random(11)
    kinds = [*BROKEN, "# c", "", None, "'", BROKEN[4], BROKEN[1]]
    files = {f: [r.choice(kinds) for _ in range(r.randint(1, 60))] for f in "abcd"}
    data = [(100 * k + i, f, i + 1, x, "gff3", 7) for k, (f, lines) in enumerate(files.items()) for i, x in enumerate(lines)]
    data += [(900, None, 1, BROKEN[0], "gff3", 7), (901, None, 2, BROKEN[1], "gff3", 7), (902, "e", None, BROKEN[0], "gff3", 7), (903, "e", 1, BROKEN[1], "gff3", 7)]
    r.shuffle(data)
    df = spark.createDataFrame(data, "line_id long, file_name string, line_no int, line string, dialect string, faults int")
    got = {x.line_id: x for x in records.resumed_lines(df, block=7).collect()}
    want = {}
    for k, (_, lines) in enumerate(files.items()):
        for i, _, broken in records.read_lines(lines, "gff3"):
            want[100 * k + i] = None if broken is None else broken + 1
    assert any(want.values()) and {i: x.broken_no for i, x in got.items() if i < 900} == want
    assert {i: x.broken_no for i, x in got.items() if i >= 900} == dict.fromkeys((900, 901, 902, 903))
    lines = {d[0]: d[3] for d in data}
    for i, x in got.items():
        own = [tuple(f) for f in records.read_line(lines[i], "gff3").faults]
        assert [tuple(f) for f in x.faults] == ([("quoting", 0, 0, records.PASSED_OVER)] if x.broken_no else []) + own


def test_typed_values(spark):
    df = spark.createDataFrame([(1, "c\ts\tt\t7\tx\t1e-5\t+\t2\tID=a", "gff3"), (2, "c\ts\tt\t7\t9\t.\t.\t.\tID=a", "gff3")], "line_id long, line string, dialect string")
    one, two = sorted(records.valid(records.parse_lines(df)).collect())
    assert (one.start, one.end, one.score, one.phase) == (7, None, 1e-5, 2) and (two.end, two.score, two.phase) == (9, None, None)
    assert one.attributes[0].key == "ID"
