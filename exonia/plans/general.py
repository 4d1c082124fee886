"""The queries of the general problems 1, 3, 4 and 5, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exonia.operators import intervals, packed, records, references
from exonia.session import join_null_safe, table


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.parse_lines(table(spark, sf_dir, "gff_raw"), file="file_name")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.faulty(_parsed(spark, sf_dir)).select("line_id", "reason")


def p1_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = records.valid(_parsed(spark, sf_dir))
    return parsed.select("line_id", "seqid", "type", "start", "end", "strand", F.size("attributes").cast("bigint").alias("n_attributes"))


def p1_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Located faults of every failing line."""
    bad = records.faulty(_parsed(spark, sf_dir))
    return bad.select("line_id", F.posexplode("faults").alias("nth", "f")).select("line_id", "nth", "f.reason", F.col("f.column").alias("column_no"), "f.offset", "f.message")


def p1_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Located faults of the lines as parts of their files: after a broken quote reading goes on at the next record start."""
    lines = records.resumed_lines(table(spark, sf_dir, "gff_raw"))
    return lines.select("line_id", "broken_no", F.posexplode("faults").alias("nth", "f")).select("line_id", "broken_no", "nth", "f.reason", F.col("f.column").alias("column_no"), "f.offset", "f.message")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.coding_blocks(table(spark, sf_dir, "genepred"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    return references.orphans(t("gff"), t("contig"), t("protein_sequence"), t("genepred"))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_found(spark, sf_dir).groupBy("tbl", "load_month", "kind").agg(F.count("*").alias("n"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.unpacked(table(spark, sf_dir, "gff"), table(spark, sf_dir, "genepred"))


def p5_delimiters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of the candidate delimiters for each source of both packed fields, and which one the source's fields are split by."""

    def scored(name: str, field: str, source: list[str], reading: packed.Reading) -> DataFrame:
        counted = packed.cells(table(spark, sf_dir, name), source, field, reading)
        s = packed.scores(counted, source, reading)
        best = packed.inferred(counted, source, reading).withColumn("chosen", F.lit(True))
        every = join_null_safe(s, best, [*source, "mark"], "left")
        dialect = F.col("dialect") if "dialect" in source else F.lit("")
        rounded = (F.round(c, 6).alias(c) for c in ("consistency", "regularity"))
        return every.select(F.lit(name).alias("tbl"), "organism", dialect.alias("dialect"), "mark", "fields", *rounded, F.coalesce("chosen", F.lit(False)).alias("chosen"))

    attributes = scored("gff", "gff_attr", ["organism", "dialect"], packed.ATTRIBUTES)
    return attributes.unionByName(scored("genepred", "exonstarts", ["organism"], packed.NUMBERS))


QUERIES = {f.__name__: f for f in (p1_found, p1_valid, p1_faults, p1_resumed, p3_found, p4_found, p4_report, p5_found, p5_delimiters)}

# One attribute piece for RE2, and its key, the part before its value and a closed value with its marks.
_PIECE = r"""(?:[^ \t\r\n=;|]+[ \t\r\n]*=?|=)[ \t\r\n]*(?:"[^"]*"[^;|]*|''[^'']*''[^;|]*|["''](?s:.*)|[^;|"''][^;|]*|)"""
_KEY = r"^[^ \t\r\n=;|]*"
_HEAD = r"^[^ \t\r\n=;|]*[ \t\r\n]*=?[ \t\r\n]*"
_CLOSED = r"""^(?:"([^"]*)"|''([^'']*)'')"""
_TRIM = "' ' || chr(9) || chr(13) || chr(10)"


def _pieces(attr: str) -> str:
    """SQL: a list of (k, v, bad) of an attribute field; bad: its quoting is broken."""
    closed, opened = f"regexp_matches(q.v, '{_CLOSED}')", "left(q.v, 1) IN (chr(34), chr(39))"
    return f"""list_transform(
        list_transform(regexp_extract_all({attr}, '{_PIECE}'), lambda p: {{'k': regexp_extract(p, '{_KEY}'), 'v': regexp_replace(p, '{_HEAD}', '')}}),
        lambda q: {{'k': q.k,
          'v': CASE WHEN {closed} THEN regexp_extract(q.v, '{_CLOSED}', 1) || regexp_extract(q.v, '{_CLOSED}', 2)
                    WHEN {opened} THEN rtrim(substr(q.v, 2), {_TRIM}) ELSE rtrim(q.v, {_TRIM}) END,
          'bad': contains(q.k, chr(34)) OR CASE WHEN {closed} THEN NOT regexp_full_match(q.v, '{_CLOSED[1:]}[ \\t\\r\\n]*')
                    WHEN {opened} THEN true ELSE contains(q.v, chr(34)) END}})"""


def _delimiter_scores(name: str, field: str, source: str, dialect: str, candidates: list[tuple[str, str, str]], marks: str) -> str:
    """SQL: the rows of p5_delimiters for one table; candidates: (mark, number of pieces, whether all are regular)."""
    style = " + ".join(f"CASE WHEN contains({field}, {_text(m)}) THEN {1 << i} ELSE 0 END" for i, m in enumerate(marks))
    each = ", ".join(f"{{'k': {i}, 'mark': {_text(m)}, 'bit': {1 << i if len(m) == 1 else -1}, 'n': {n}, 'good': {good}}}" for i, (m, n, good) in enumerate(candidates))
    return f"""
      SELECT '{name}' AS tbl, organism, {dialect} AS dialect, mark, fields, round(consistency, 6) AS consistency, round(regularity, 6) AS regularity,
        k < {len(marks)} AND row_number() OVER (PARTITION BY {source} ORDER BY (k < {len(marks)}) DESC, consistency * regularity DESC, k) = 1 AS chosen
      FROM (SELECT {source}, c.k AS k, c.mark AS mark, count(*) AS fields, avg(c.good::INT) AS regularity,
          avg((style = 0 OR style & c.bit <> 0)::INT) / (1 + coalesce(sqrt(greatest(0, sum(c.n * c.n) / count(*) - (sum(c.n) / count(*)) ^ 2)) / nullif(sum(c.n) / count(*), 0), 0)) AS consistency
        FROM (SELECT {source}, {style} AS style, unnest([{each}]) AS c FROM {name} WHERE {field} IS NOT NULL) GROUP BY ALL)"""


def _text(s: str) -> str:
    """SQL: a string of marks."""
    return "chr(9)" if s == "\t" else f"'{s}'"


def _attribute_candidate(m: str) -> tuple[str, str, str]:
    blank = r" \t\r\n"
    value = rf"""(?:"[^"]*"|''[^'']*''|[^{blank};|"''][^;|"]*)"""
    bare = value.replace(f"[^{blank};", f"[^{blank}=;")
    piece = rf"""[^{blank}=;|"'']+(?:[{blank}]*=[{blank}]*{value}|[{blank}]+{bare})[{blank}]*"""
    regular = rf"[{blank}{m}]*(?:{piece}(?:[{m}][{blank}{m}]*|\z))*"
    trimmed = f"trim(gff_attr, {_TRIM} || '{m}')"
    plain = f"CASE WHEN {trimmed} = '' THEN 0 ELSE len(string_split_regex({trimmed}, '[{m}][{blank}{m}]*')) END"
    quoted = f"contains(gff_attr, chr(34)) OR contains(gff_attr, chr(39))"
    return m, f"CASE WHEN {quoted} THEN len(regexp_extract_all(gff_attr, '{_PIECE.replace(';|', m)}')) ELSE {plain} END", f"regexp_full_match(gff_attr, '{regular}')"


def _number_candidate(m: str) -> tuple[str, str, str]:
    dressing = "".join(rf"\{c}" for c in "{}[]()") + r" \t\r\n\"''"
    own = dressing.replace(" ", "") if m == " " else dressing.replace(r"\t", "") if m == "\t" else dressing
    mark = r"\t" if m == "\t" else rf"\{m}" if m == "|" else m
    trimmed = f"trim(exonstarts, {_TRIM} || '{{}}[]()' || chr(34) || chr(39) || {_text(m)})"
    n = f"CASE WHEN {trimmed} = '' THEN 0 ELSE len(string_split_regex({trimmed}, '{mark}[{dressing}{mark}]*')) END"
    return m, n, f"regexp_full_match(exonstarts, '[{dressing}{mark}]*(?:[0-9]+[{own}]*(?:{mark}[{dressing}{mark}]*|\\z))*')"


_EXONS = """
  SELECT row_id, organism, chrom, gene, strand, unnest(s)::BIGINT AS pos_start, unnest(e)::BIGINT AS pos_end
  FROM (SELECT *, regexp_extract_all(exonstarts, '[0-9]+') AS s, regexp_extract_all(exonends, '[0-9]+') AS e FROM genepred)
  WHERE len(s) = len(e)"""

_P1 = f"""
  WITH t AS (SELECT line_id, dialect, trim(line, {_TRIM}) AS x FROM gff_raw),
  r AS (SELECT line_id, dialect, string_split(x, chr(9)) AS c FROM t WHERE x <> '' AND left(x, 1) <> '#'),
  p AS (SELECT *, CASE WHEN len(c) = 9 THEN {_pieces("c[9]")} END AS ps FROM r),
  j AS (SELECT line_id, c, ps, CASE
      WHEN len(c) <> 9 THEN 'columns'
      WHEN list_bool_or(list_transform(ps, lambda q: q.bad)) THEN 'quoting'
      WHEN trim(c[7], ' ') NOT IN ('+', '-', '.') OR NOT regexp_full_match(trim(c[1], ' '), '(?:[A-Za-z0-9.:^*$@!+_?|-]|%[0-9A-Fa-f][0-9A-Fa-f])+')
        OR list_bool_or(list_transform(ps, lambda q: q.k = '' OR q.v = ''))
        OR NOT coalesce(list_bool_or(list_transform(ps, lambda q: q.k = CASE dialect WHEN 'gff3' THEN 'ID' WHEN 'gtf' THEN 'transcript_id' WHEN 'jgi' THEN 'proteinId' END)), false)
        THEN 'value' END AS reason FROM p)"""

#: f(line_id, nth, reason, column_no, off, message): the faults of each record in order; pieces are taken off the attributes one by
#: one, after a quote that isn't closed up to the next piece that starts like an attribute. broken(line_id): such records.
_SEP = f"{_TRIM} || ';|'"
_FAULTS = f"""
  WITH RECURSIVE t AS (SELECT line_id, dialect, trim(line, {_TRIM}) AS x FROM gff_raw),
  r AS (SELECT line_id, dialect, x, string_split(x, chr(9)) AS c FROM t WHERE x <> '' AND left(x, 1) <> '#'),
  nine AS (SELECT *, length(x) - length(c[9]) AS start FROM r WHERE len(c) = 9),
  steps AS (
    SELECT line_id, 0 AS k, ltrim(c[9], {_SEP}) AS rest, start + length(c[9]) - length(ltrim(c[9], {_SEP})) AS off, '' AS key, [{{'reason': '', 'column_no': 9, 'off': 0::BIGINT, 'message': ''}}][2:] AS faults FROM nine
    UNION ALL
    SELECT line_id, k + 1, ltrim(after, {_SEP}), off + length(rest) - length(ltrim(after, {_SEP})), key, list_filter([
        {{'reason': CASE WHEN contains(key, chr(34)) THEN 'quoting' END, 'column_no': 9, 'off': off::BIGINT, 'message': 'quote in a key'}},
        {{'reason': CASE WHEN key = '' THEN 'value' END, 'column_no': 9, 'off': off::BIGINT, 'message': 'empty key'}},
        {{'reason': CASE WHEN kind = 'open' OR kind = 'closed' AND trim(tail, {_TRIM}) <> '' OR kind = 'plain' AND contains(value, chr(34)) THEN 'quoting' END, 'column_no': 9,
          'off': (begin + CASE kind WHEN 'open' THEN 0 WHEN 'closed' THEN length(value) + 2 ELSE instr(value, chr(34)) - 1 END)::BIGINT, 'message': CASE kind WHEN 'open' THEN 'quote isn''t closed' WHEN 'closed' THEN 'text after a closing quote' ELSE 'quote in a value' END}},
        {{'reason': CASE WHEN value = '' THEN 'value' END, 'column_no': 9, 'off': begin::BIGINT, 'message': 'empty value'}}], lambda z: z.reason IS NOT NULL)
    FROM (
      SELECT *, CASE kind WHEN 'closed' THEN substr(v, length(value) + 3 + length(tail)) WHEN 'open' THEN substr(v, length(taken) + 1) ELSE substr(v, length(taken) + 1) END AS after
      FROM (
        SELECT *, CASE kind WHEN 'closed' THEN regexp_extract(v, '{_CLOSED}', 1) || regexp_extract(v, '{_CLOSED}', 2) WHEN 'open' THEN rtrim(substr(taken, 2), {_TRIM}) ELSE rtrim(taken, {_TRIM}) END AS value,
          CASE kind WHEN 'closed' THEN regexp_extract(v, '{_CLOSED[1:]}([^;|]*)', 3) ELSE '' END AS tail
        FROM (
          SELECT *, CASE kind WHEN 'closed' THEN '' WHEN 'open' THEN CASE WHEN regexp_matches(v, '{{ANCHOR}}') THEN regexp_extract(v, '^(?s:(.*?)){{ANCHOR}}', 1) ELSE v END ELSE regexp_extract(v, '^[^;|]*') END AS taken
          FROM (
            SELECT *, off + length(rest) - length(v) AS begin, CASE WHEN regexp_matches(v, '{_CLOSED}') THEN 'closed' WHEN left(v, 1) IN (chr(34), chr(39)) THEN 'open' ELSE 'plain' END AS kind
            FROM (SELECT line_id, k, rest, off, regexp_extract(rest, '{_KEY}') AS key, regexp_replace(rest, '{_HEAD}', '') AS v FROM steps WHERE rest <> ''))))),
  ),
  own AS (SELECT line_id, list(key ORDER BY k) FILTER (WHERE k > 0) AS keys, flatten(list(faults ORDER BY k)) AS faults FROM steps GROUP BY line_id),
  judged AS (
    SELECT line_id, [{{'reason': 'columns', 'column_no': 0, 'off': 0::BIGINT, 'message': len(c)::VARCHAR || ' columns'}}] AS faults FROM r WHERE len(c) <> 9
    UNION ALL
    SELECT n.line_id, own.faults || list_filter([
        {{'reason': CASE WHEN trim(c[7], ' ') NOT IN ('+', '-', '.') THEN 'value' END, 'column_no': 7, 'off': (list_sum(list_transform(c[1:6], lambda z: length(z))) + 6)::BIGINT, 'message': 'strand'}},
        {{'reason': CASE WHEN NOT regexp_full_match(trim(c[1], ' '), '(?:[A-Za-z0-9.:^*$@!+_?|-]|%[0-9A-Fa-f][0-9A-Fa-f])+') THEN 'value' END, 'column_no': 1, 'off': 0::BIGINT, 'message': 'seqid'}},
        {{'reason': CASE WHEN NOT coalesce(list_contains(keys, CASE dialect WHEN 'gff3' THEN 'ID' WHEN 'gtf' THEN 'transcript_id' WHEN 'jgi' THEN 'proteinId' END), false) THEN 'value' END, 'column_no': 9, 'off': start::BIGINT, 'message': 'no identifier'}}], lambda z: z.reason IS NOT NULL)
    FROM nine n JOIN own ON n.line_id = own.line_id),
  f AS (SELECT line_id, generate_subscripts(faults, 1) - 1 AS nth, unnest(faults) AS q FROM judged)""".replace("{ANCHOR}", r"""[;|][ \t\r\n]*[A-Za-z_][A-Za-z0-9_.]*(?:[ \t]*=|[ \t]+["''A-Za-z0-9_])""").replace("))))),\n  )", ")))))\n  )")

_P4 = """
  WITH refs AS (
    SELECT 'gff' AS tbl, row_id, organism AS org, trim(gff_seqid, ' ') AS name, loaded_at AS t FROM gff WHERE trim(gff_seqid, ' ') <> ''
    UNION ALL SELECT 'protein_sequence', row_id, organism, seq_id, loaded_at FROM protein_sequence WHERE trim(seq_id, ' ') <> ''),
  parents AS (
    SELECT 'gff' AS tbl, organism AS org, chrom AS name, loaded_at AS l, withdrawn_at AS w FROM contig
    UNION ALL SELECT 'protein_sequence', organism, accno, loaded_at, withdrawn_at FROM genepred),
  joined AS (
    SELECT r.tbl, r.row_id, r.t, p.l, p.w, p.name AS hit FROM refs r LEFT JOIN parents p ON r.tbl = p.tbl AND r.name = p.name AND r.org = p.org WHERE r.org IS NOT NULL OR r.tbl = 'gff'
    UNION ALL SELECT r.tbl, r.row_id, r.t, p.l, p.w, p.name FROM refs r LEFT JOIN parents p ON r.tbl = p.tbl AND r.name = p.name WHERE r.org IS NULL AND r.tbl = 'protein_sequence'),
  judged AS (
    SELECT tbl, row_id, strftime(any_value(t), '%Y-%m') AS load_month, bool_or(coalesce(l <= t AND (w IS NULL OR t < w), false)) AS live,
      CASE WHEN count(hit) = 0 THEN 'missing' WHEN bool_or(coalesce(l <= t, false)) THEN 'deleted' ELSE 'late' END AS kind
    FROM joined GROUP BY tbl, row_id)"""

ORACLE = {
    "p1_found": _P1 + " SELECT line_id, reason FROM j WHERE reason IS NOT NULL",
    "p1_valid": _P1
    + """ SELECT line_id, trim(c[1], ' ') AS seqid, trim(c[3], ' ') AS type, try_cast(trim(c[4], ' ') AS BIGINT) AS "start", try_cast(trim(c[5], ' ') AS BIGINT) AS "end",
      trim(c[7], ' ') AS strand, len(ps)::BIGINT AS n_attributes FROM j WHERE reason IS NULL""",
    "p1_faults": _FAULTS + " SELECT line_id, nth::INT AS nth, q.reason AS reason, q.column_no::INT AS column_no, q.off::INT AS \"offset\", q.message AS message FROM f",
    "p1_resumed": _FAULTS
    + r""", line AS (SELECT g.line_id, file_name, line_no, x = '' OR left(x, 1) = '#' OR regexp_matches(x, '^[^\t\n]+\t[^\t\n]*\t[^\t\n]*\t[ ]*[0-9]+[ ]*\t[ ]*[0-9]+[ ]*\t[^\t\n]*\t[ ]*[-+.][ ]*\t[^\t\n]*\t') AS stops,
        g.line_id IN (SELECT line_id FROM f WHERE q.message = 'quote isn''t closed') AS broken FROM gff_raw g JOIN (SELECT line_id, coalesce(x, '') AS x FROM t) USING (line_id)),
      held AS (SELECT *, last_value(CASE WHEN broken THEN line_no WHEN stops THEN -1 END IGNORE NULLS) OVER (PARTITION BY file_name ORDER BY line_no, line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM line),
      after_ AS (SELECT line_id, CASE WHEN NOT stops AND before > 0 THEN before END AS broken_no FROM held),
      every AS (
        SELECT f.line_id, a.broken_no, nth + (a.broken_no IS NOT NULL)::INT AS nth, q FROM f JOIN after_ a USING (line_id)
        UNION ALL SELECT line_id, broken_no, 0, {'reason': 'quoting', 'column_no': 0, 'off': 0::BIGINT, 'message': 'after a quote that isn''t closed'} FROM after_ JOIN r USING (line_id) WHERE broken_no IS NOT NULL)
      SELECT line_id, broken_no::INT AS broken_no, nth::INT AS nth, q.reason AS reason, q.column_no::INT AS column_no, q.off::INT AS "offset", q.message AS message FROM every""",
    "p3_found": f"""
      WITH x AS (SELECT DISTINCT organism, chrom, gene, strand, pos_start, pos_end FROM ({_EXONS}) WHERE gene IS NOT NULL AND strand IS NOT NULL AND pos_end > pos_start),
      m AS (SELECT *, max(pos_end) OVER (PARTITION BY organism, chrom, gene, strand ORDER BY pos_start, pos_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x),
      n AS (SELECT *, sum(CASE WHEN reach IS NULL OR pos_start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY organism, chrom, gene, strand ORDER BY pos_start, pos_end ROWS UNBOUNDED PRECEDING) AS island FROM m),
      b AS (SELECT organism, chrom, gene, strand, island, min(pos_start) AS lo, max(pos_end) AS hi FROM n GROUP BY ALL),
      g AS (SELECT *, lead(lo) OVER (PARTITION BY organism, chrom, gene, strand ORDER BY lo) AS nxt FROM b)
      SELECT organism, chrom, gene, strand, 'block' AS kind, lo::INT AS pos_start, hi::INT AS pos_end FROM b
      UNION ALL SELECT organism, chrom, gene, strand, 'gap', hi::INT, nxt::INT FROM g WHERE nxt IS NOT NULL""",
    "p4_found": _P4 + " SELECT tbl, row_id, load_month, kind FROM judged WHERE NOT live",
    "p4_report": _P4 + " SELECT tbl, load_month, kind, count(*) AS n FROM judged WHERE NOT live GROUP BY ALL",
    "p5_found": f"""
      SELECT 'gff' AS tbl, row_id, pos::INT AS pos, q.k AS tag, q.v AS item
      FROM (SELECT row_id, unnest(ps) AS q, generate_subscripts(ps, 1) AS pos FROM (SELECT row_id, {_pieces("gff_attr")} AS ps FROM gff WHERE gff_attr IS NOT NULL))
      UNION ALL SELECT 'genepred', row_id, pos::INT, '', item
      FROM (SELECT row_id, unnest(x) AS item, generate_subscripts(x, 1) AS pos FROM (SELECT row_id, regexp_extract_all(exonstarts, '[0-9]+') AS x FROM genepred WHERE exonstarts IS NOT NULL))""",
    "p5_delimiters": _delimiter_scores("gff", "gff_attr", "organism, dialect", "dialect", [_attribute_candidate(m) for m in (";", "|", ";|")], ";|")
    + " UNION ALL "
    + _delimiter_scores("genepred", "exonstarts", "organism", "''", [*map(_number_candidate, ",;|/\t "), ("other", "len(regexp_extract_all(exonstarts, '[0-9]+'))", "true")], ",;|/\t "),
}
