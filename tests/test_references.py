"""Problem 4 against a nested loop."""

import random
from datetime import datetime, timedelta

from exonia.operators import references
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1)
DAY = timedelta(days=1)


def brute(refs, parents):
    out = []
    for key, at, row in refs:
        own = [(lo, hi) for k, lo, hi in parents if k == key and key is not None]
        if at is None:
            if not own:
                out.append((row, "missing"))
            continue
        if any(lo is not None and lo <= at and (hi is None or at < hi) for lo, hi in own):
            continue
        kind = "missing" if not own else "deleted" if any(lo is not None and lo <= at for lo, _ in own) else "late"
        out.append((row, kind))
    return sorted(out, key=str)


def test_random(spark):
    r = random.Random(3)
    when = lambda: T0 + r.randint(0, 40) * DAY / 4
    keys = ["hot", "hot", "hot", "a", "b", "c", "gone", None]
    parents = [(r.choice(["hot", "a", "b", "c", None]), r.choice([when(), when(), None]), r.choice([None, when(), when()])) for _ in range(40)]
    parents += [("never", None, None), ("tie", T0, T0 + DAY)]
    refs = [(r.choice(keys), r.choice([when()] * 9 + [None]), i) for i in range(600)]
    refs += [("never", T0, 9001), ("tie", T0, 9002), ("tie", T0 + DAY, 9003), ("tie", T0 - DAY, 9004), ("tie", T0 + DAY, 9003)]
    a = spark.createDataFrame(refs, "k string, at timestamp_ntz, row_id int").withColumn("kind2", F.lit(1))
    b = spark.createDataFrame(parents, "k string, loaded_at timestamp_ntz, withdrawn_at timestamp_ntz").withColumn("at2", F.lit(2))
    for spread in (3, 100_000):
        got = references.unresolved(a, b, ["k"], spread)
        assert sorted(((x.row_id, x.kind) for x in got.collect()), key=str) == brute(refs, parents)
    assert references.unresolved(a.limit(0), b, ["k"]).collect() == []
    assert {x.kind for x in references.unresolved(a.where("at is not null"), b.limit(0), ["k"]).collect()} == {"missing"}


def test_orphans(spark):
    ts = "timestamp_ntz"
    gff = spark.createDataFrame([(1, "o", " c ", T0), (2, "o", "C", T0), (3, "o", " ", T0), (4, "o", None, T0), (5, None, "c", T0), (6, "o", "c", T0 - DAY)], f"row_id long, organism string, gff_seqid string, loaded_at {ts}")
    contig = spark.createDataFrame([("o", "c", T0, None)], f"organism string, chrom string, loaded_at {ts}, withdrawn_at {ts}")
    protein = spark.createDataFrame([(1, None, "p", T0), (2, "o", "p", T0), (3, "o2", "p", T0 + DAY), (4, None, None, T0), (5, None, "q", T0)], f"row_id long, organism string, seq_id string, loaded_at {ts}")
    genepred = spark.createDataFrame([("o2", "p", T0 - DAY, T0 + DAY), (None, None, T0, None)], f"organism string, accno string, loaded_at {ts}, withdrawn_at {ts}")
    got = sorted(tuple(x) for x in references.orphans(gff, contig, protein, genepred).collect())
    assert got == [
        ("gff", 2, "2024-01", "missing"), ("gff", 5, "2024-01", "missing"), ("gff", 6, "2023-12", "late"),
        ("protein_sequence", 2, "2024-01", "missing"), ("protein_sequence", 3, "2024-01", "deleted"), ("protein_sequence", 5, "2024-01", "missing"),
    ]
