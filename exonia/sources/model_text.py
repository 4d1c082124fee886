"""Statistics models: a folder of small Parquet tables, and a text form for interchange.

Tables: organisms (organism, place), columns (code, n), motifs (organism, site, kind, motif_idx, n), edges (organism, site,
kind, place, nuc_idx, n), lengths (organism, weight, rate, shift, fail), codons (organism, kind, class, codon_idx, n). site
is donor or acceptor, kind is real or null."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from exonia.functions.seq import NUCLEOTIDES, code_by_index
from exonia.operators.counting import ACCEPTOR_SIZE, DONOR_SIZE

SCHEMAS = {
    "organisms": "organism string, place int",
    "columns": "code string, n bigint",
    "motifs": "organism string, site string, kind string, motif_idx int, n bigint",
    "edges": "organism string, site string, kind string, place int, nuc_idx int, n bigint",
    "lengths": "organism string, weight double, rate double, shift int, fail double",
    "codons": "organism string, kind string, class string, codon_idx int, n bigint",
}
CLASSES = ("first", "middle", "last")
#: Rows of one table at most that are written as text; column types are the only ones that can be many.
MAX_ROWS = 50_000_000


def save(model: dict[str, DataFrame], folder: str) -> None:
    for name, schema in SCHEMAS.items():
        model[name].select(*(c.split(" ")[0] for c in schema.split(", "))).write.mode("overwrite").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in SCHEMAS.items()}


def _bases(index: int, n: int) -> str:
    return "".join(NUCLEOTIDES[index >> 2 * (n - 1 - k) & 3] for k in range(n)) if index >= 0 else "-"


def _codon_blocks(codons: dict) -> Iterator[str]:
    yield "#CODON"
    code = code_by_index()
    for i in range(64):
        yield "\t".join([*(str(codons.get((c, i), 0)) for c in CLASSES), f"# {_bases(i, 3)}/{code[i]}"])


def lines(model: dict[str, DataFrame]) -> Iterator[str]:
    """The text form, line by line. Rows come one partition after the other; all tables but the columns are small."""
    order = [r.organism for r in model["organisms"].orderBy("place").collect()]
    yield "#exonia model\t1"
    yield "#ORGANISMS"
    yield "\t".join(order)
    yield "#SUBST"
    columns = model["columns"].orderBy("code")
    n = columns.count()
    if n > MAX_ROWS:
        raise ValueError("too many column types for the text form; use the tables")
    yield f"{n}"
    for r in columns.toLocalIterator():
        yield f"|\t{r.code}\t{r.n}"
    motifs, edges, codons = {}, {}, {}
    for r in model["motifs"].collect():
        motifs.setdefault((r.organism, r.site, r.kind), {})[r.motif_idx] = r.n
    for r in model["edges"].collect():
        edges.setdefault((r.organism, r.site, r.kind), {})[r.place, r.nuc_idx] = r.n
    for r in model["codons"].collect():
        codons.setdefault((r.organism, r.kind), {})[r["class"], r.codon_idx] = r.n
    lengths = {r.organism: r for r in model["lengths"].collect()}
    for org in order:
        for site, title, (m, b) in (("donor", "SS5", DONOR_SIZE), ("acceptor", "SS3", ACCEPTOR_SIZE)):
            for kind in ("real", "null"):
                yield f"#{title}{'/null' if kind == 'null' else ''} {org}"
                yield "#SPLICE"
                yield f"{m}\t{b}\t{str(site == 'donor').lower()}"
                own, at = motifs.get((org, site, kind), {}), edges.get((org, site, kind), {})
                yield f"{len(own)}"
                for idx, count in sorted(own.items(), key=lambda x: (-x[1], x[0])):
                    yield f"{idx}\t{count}\t# {_bases(idx, m)}"
                for place in range(b):
                    yield "\t".join([*(str(at.get((place, k), 0)) for k in range(4))])
        yield f"#ILEN {org}"
        yield "#INTRON_LENGTH"
        r = lengths.get(org)
        yield f"{r.weight}\t{r.rate}\t{r.shift}\t{r.fail}" if r else "NaN\tNaN\t0\tNaN"
        for kind in ("real", "null"):
            yield f"#CODON{'/null' if kind == 'null' else ''} {org}"
            yield from _codon_blocks(codons.get((org, kind), {}))
    yield "#END"


def write(model: dict[str, DataFrame], path: str) -> None:
    with open(path, "w", encoding="ascii") as f:
        f.writelines(line + "\n" for line in lines(model))


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a text form. Lines that begin with # are comments; sections follow each other in a fixed order."""
    import gzip

    opened = gzip.open(path, "rt", encoding="ascii") if path.endswith(".gz") else open(path, encoding="ascii")
    rows: dict[str, list] = {name: [] for name in SCHEMAS}
    with opened as f:
        body = (line.rstrip("\n").split("\t") for line in f if not line.startswith("#"))
        order = next(body)
        rows["organisms"] = [(o, k) for k, o in enumerate(order)]
        for _ in range(int(next(body)[0])):
            _, code, n = next(body)
            rows["columns"].append((code, int(n)))
        for org in order:
            for site in ("donor", "acceptor"):
                for kind in ("real", "null"):
                    size = next(body)
                    for _ in range(int(next(body)[0])):
                        idx, n, *_ = next(body)
                        rows["motifs"].append((org, site, kind, int(idx), int(n)))
                    for place in range(int(size[1])):
                        rows["edges"] += [(org, site, kind, place, k, int(n)) for k, n in enumerate(next(body)[:4]) if int(n)]
            weight, rate, shift, fail = next(body)[:4]
            rows["lengths"].append((org, float(weight), float(rate), int(shift), float(fail)))
            for kind in ("real", "null"):
                for i in range(64):
                    rows["codons"] += [(org, kind, c, i, int(n)) for c, n in zip(CLASSES, next(body)[:3], strict=True) if int(n)]
    return {name: spark.createDataFrame(rows[name], schema) for name, schema in SCHEMAS.items()}
