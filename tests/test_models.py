"""Scores, special functions, fits, trees, parsimony and the model's text form."""

import itertools
import math
import random

import numpy as np
import pytest
from exonia.functions import special
from exonia.operators import lengths, parsimony, scoring
from exonia.sources import model_text, newick


def test_generic_scores():
    donor, acceptor = scoring.generic_scores("donor"), scoring.generic_scores("acceptor")
    assert (donor["GT"], donor["GC"], donor["AT"], donor["AA"]) == (1199, -1092, -1092, scoring.NEVER)
    assert (acceptor["AG"], acceptor["AC"], acceptor["TG"], acceptor["GT"]) == (1195, -795, -795, scoring.NEVER)


def test_score_table(spark):
    counts = spark.createDataFrame([("a", 0, 6), ("a", 1, 2)], "g string, i int, n bigint")
    null = spark.createDataFrame([("a", 0, 2), ("a", 2, 2)], "g string, i int, n bigint")
    got = {r.i: r.score for r in scoring.score_table(counts, null, ["g"], "i", 4).collect()}
    assert got == {0: int(math.log10(0.75 / 0.5) * 1000), 1: scoring.ALWAYS, 2: scoring.NEVER, 3: 0}
    assert scoring.score_table(counts.limit(0), null, ["g"], "i", 4).collect() == []


def test_special_functions():
    assert special.gammp(3.5, 2.0) == pytest.approx(1 - special.gammq(3.5, 2.0))
    for k in range(1, 30, 4):
        for rate in (0.3, 4.0, 25.0):
            exact = sum(math.exp(special.poisson_ln(rate, i)) for i in range(k))
            assert special.poisson_cumulative(rate, k) == pytest.approx(exact, rel=1e-9)
            assert special.poisson_tail(rate, k) == pytest.approx(1 - exact, abs=1e-9)
    assert special.betai(2, 3, 0.4) == pytest.approx(sum(math.comb(4, j) * 0.4**j * 0.6 ** (4 - j) for j in range(2, 5)))
    assert special.student_t(2.0, 1e7) == pytest.approx(2 * special.normal_cdf(-2.0), rel=1e-5)
    assert special.student_t(1.0, 1) == pytest.approx(0.5)
    assert special.chi_square_tail(2, 3.0) == pytest.approx(math.exp(-1.5))
    assert special.log_erfcc(24.9) == pytest.approx(math.log(math.erfc(24.9))) and special.log_erfcc(40) == pytest.approx(-1604.2614, abs=1e-3)
    assert special.bicoln(10, 3) == pytest.approx(math.log(120)) and special.factorial(5) == 120 and special.powers(2, 3) == [1, 2, 4, 8]
    x, fx = special.minimum(lambda v: (v - 1.7) ** 2 + 3, -10, 0, 10)
    assert (x, fx) == (pytest.approx(1.7, abs=1e-5), pytest.approx(3))
    x, _ = special.minimum(lambda v: abs(v - 0.3), 0, 0.9, 1)
    assert x == pytest.approx(0.3, abs=1e-5)


def test_special_columns(spark):
    df = spark.createDataFrame([(2.0, 3.0), (None, 1.0), (-1.0, 2.0)], "a double, b double")
    assert [r.v for r in df.select(special.column(special.poisson_ln, "a", "b").alias("v")).collect()] == [pytest.approx(3 * math.log(2) - 2 - math.log(6)), None, None]
    assert df.select(special.column(special.gammln, "b").alias("v")).first().v == pytest.approx(math.log(2))


def test_length_fit_is_near_the_truth(spark):
    r = np.random.default_rng(1)
    sample = np.where(r.random(6000) < 0.6, r.poisson(60, 6000), r.geometric(0.01, 6000))
    value, n = np.unique(sample, return_counts=True)
    got = lengths.fit(value, n)
    assert got["weight"] == pytest.approx(0.6, abs=0.05) and got["rate"] == pytest.approx(60, abs=1) and got["fail"] == pytest.approx(0.99, abs=0.003)
    kept = lengths.kept(value.astype(float), n.astype(float))
    likelihood = lambda w, rate, fail: float((n[kept] * lengths.log_density(value[kept].astype(float), w, rate, fail)).sum())
    assert got["log_likelihood"] == pytest.approx(likelihood(got["weight"], got["rate"], got["fail"])) and got["log_likelihood"] >= likelihood(0.6, 60, 0.99)
    for dw, dr, df in ((0.01, 0, 0), (-0.01, 0, 0), (0, 0.5, 0), (0, -0.5, 0), (0, 0, 0.0005), (0, 0, -0.0005)):
        assert likelihood(got["weight"] + dw, got["rate"] + dr, got["fail"] + df) <= got["log_likelihood"]
    df = spark.createDataFrame([("a", int(v), int(k)) for v, k in zip(value, n)] + [("zero", 0, 5), ("one", 7, 1)], "organism string, value int, n bigint")
    rows = {x.organism: x for x in lengths.fitted(df).collect()}
    assert rows["a"].rate == pytest.approx(got["rate"]) and {x.shift for x in rows.values()} == {1}
    assert rows["zero"].rate is None or math.isnan(rows["zero"].rate)


def test_length_density_sums_to_one():
    at = np.arange(0, 20000)
    assert np.exp(lengths.log_density(at.astype(float), 0.3, 50.0, 0.99)).sum() == pytest.approx(1)
    assert lengths.log_density(np.array([3.0]), 0.0, 50.0, 0.99)[0] == pytest.approx(math.log(0.01) + 2 * math.log(0.99))


def test_gamma_as_an_expression(spark):
    x = [0.001, 0.5, 1.0, 2.0, 3.7, 10.0, 171.0, 1e6]
    got = [r.v for r in spark.createDataFrame([(v,) for v in [*x, -1.0, None]], "x double").select(special.gammln_column(special.F.col("x")).alias("v")).collect()]
    assert got[-2:] == [None, None] and got[:-2] == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-12)


TREE = [("a", "x"), ("b", "x"), ("x", "r"), ("c", "r"), ("d", "r"), ("r", None)]


def brute(tree, leaves, p):
    states = sorted({parsimony.NO_INTRON, parsimony.MISSING, *(s for own in leaves.values() for s in own)})
    inner = {parent for _, parent in tree if parent}
    names = [n for n, _ in tree]
    best = None
    for choice in itertools.product(states, repeat=len(names)):
        at = dict(zip(names, choice))
        cost = 0
        for node, parent in tree:
            if node not in inner:
                own = leaves.get(node) or {parsimony.MISSING: 0}
                if at[node] not in own:
                    break
                cost += own[at[node]]
            if parent:
                cost += parsimony.edge_cost(at[parent], at[node], p, len(tree))
        else:
            best = cost if best is None else min(best, cost)
    return best


def test_parsimony_is_optimal():
    r = random.Random(6)
    for _ in range(60):
        pool = [(2, r.randint(0, 2), r.randint(30, 32), 1) for _ in range(2)] + [parsimony.NO_INTRON]
        leaves = {n: {s: r.randint(0, 2) for s in r.sample(pool, r.randint(1, 2))} for n in r.sample("abcd", r.randint(1, 4))}
        p = parsimony.Penalties(r.randint(0, 6), r.randint(0, 12), r.randint(0, 6), 1)
        labels, cost = parsimony.label(TREE, leaves, p)
        assert cost == brute(TREE, leaves, p)
        assert set(labels) == {n for n, _ in TREE}


def test_events():
    one = (2, 100, 200, 1)
    assert parsimony.event(parsimony.NO_INTRON, one) == "Ls" and parsimony.event(parsimony.NO_INTRON, None) == "NO" and parsimony.event(parsimony.MISSING, one) == "na"
    assert parsimony.event(one, parsimony.NO_INTRON) == "Gn" and parsimony.event(one, one) == "C5,C3"
    assert parsimony.event((2, 103, 200, 1), one) == "E5(3),C3" and parsimony.event((2, 97, 206, 1), one) == "I5(3),I3(6)" and parsimony.event((2, 100, 194, 1), one) == "C5,E3(6)"
    assert parsimony.event((2, 203, 100, 1), (2, 200, 100, 1)) == "I5(3),C3"


def test_newick_round_trip(spark, tmp_path):
    text = "((a:0.1,'b c':0.25)'it''s':1e-05,(d_e,f)g:NaN)root; # comment\n[note](x,y)z:2;"
    first, second = newick.trees(text)
    assert [e[1] for e in newick.edges(first)] == ["a", "b c", "it's", "d e", "f", "g", "root"]
    again = newick.trees(newick.text(first) + ";")[0]
    assert [e[:3] for e in newick.edges(again)] == [e[:3] for e in newick.edges(first)]
    assert second.length == 2 and newick.trees("pre(a,b)post;")[0].name == "pre && post"
    assert newick.trees("(,);")[0].children[0].name is None
    assert [n.name for n in newick.trees("('d'Or':1,\"x'y\",'',\"e\"\"f\")r;")[0].children] == ["d'Or", "x'y", "", 'e"f']
    for bad in ("pre(a,b)post;", "('d'Or':1,b);"):
        with pytest.raises(ValueError):
            newick.trees(bad, relaxed=False)
    for bad in ("(a,b;", "(a,b)", "(a:x,b);", "'open", "(a,[b);", "(a:1_0,b);", '"open'):
        with pytest.raises(ValueError):
            newick.trees(bad)
    path = tmp_path / "t.tre"
    path.write_text("(a:1,b:2)r;")
    assert sorted((r.node_name, r.parent_name, r.branch_length) for r in newick.read(spark, str(path)).where("parent_name is not null").collect()) == [("a", "r", 1.0), ("b", "r", 2.0)]
    assert newick.text(newick.from_edges([("a", "r", 1.0), ("b", "r", None), ("r", None, None)])) == "(a:1,b)r"
    turned = newick.rerooted(newick.trees("((a:1,b:2)x:3,c:4)r;")[0], "x")
    assert newick.text(turned) == "(a:1,b:2,(c:4)r:3)x"
    assert [newick.number(v) for v in (0.0, float("nan"), float("inf"), 1e-9, 0.123456)] == ["0", "NaN", "Inf", "9.9e-9", "0.12346"]


def test_model_text_round_trip(spark, tmp_path):
    rows = {
        "organisms": [("aa", 0), ("bb", 1)], "columns": [("!\"", 3), ("AB", 2)], "lengths": [("aa", 0.5, 60.25, 7, 0.01), ("bb", 1.0, 2.0, 0, 0.5)],
        "motifs": [("aa", "donor", "real", 7, 5), ("aa", "donor", "real", -1, 2), ("bb", "acceptor", "null", 11, 4)], "edges": [("aa", "donor", "real", 1, 3, 9), ("bb", "acceptor", "null", 14, 0, 1)],
        "codons": [("aa", "real", "first", 13, 2), ("bb", "null", "last", 63, 8)],
    }
    model = {n: spark.createDataFrame(rows[n], s) for n, s in model_text.SCHEMAS.items()}
    path = str(tmp_path / "m.txt")
    model_text.write(model, path)
    back = model_text.read(spark, path)
    for name in rows:
        assert sorted(map(tuple, back[name].collect())) == sorted(rows[name]), name
    model_text.save(model, str(tmp_path / "folder"))
    assert sorted(map(tuple, model_text.load(spark, str(tmp_path / "folder"))["codons"].collect())) == sorted(rows["codons"])


def test_too_many_organisms_are_an_error(spark, tmp_path):
    from exonia.plans import alignments

    for n in (1000, 1001):
        edges = [(i, f"n{i:04}", "root", 1.0) for i in range(n)] + [(n, "root", None, 0.0)]
        spark.createDataFrame(edges, "postorder int, node_name string, parent_name string, branch_length double").write.parquet(f"{tmp_path}/{n}/phylo_edge.parquet")
    assert len(alignments.organism_names(spark, f"{tmp_path}/1000")) == 1000
    with pytest.raises(ValueError):
        alignments.organism_names(spark, f"{tmp_path}/1001")


def test_deep_and_broken_trees(spark):
    from exonia.operators.trees import rooted

    chain = [("n0", None, None)] + [(f"n{i}", f"n{i - 1}", 0.5) for i in range(1, 1500)]
    edges = spark.createDataFrame(chain + [("x", "y", 1.0), ("y", "x", 1.0), ("lost", "nobody", 1.0)], "node_name string, parent_name string, branch_length double")
    got = {r.node_name: r for r in rooted(edges).collect()}
    assert len(got) == 1500 and got["n1499"].depth == 1499 and got["n1499"].root_distance == 749.5
    assert [n for n, r in got.items() if r.is_leaf] == ["n1499"]
    assert rooted(edges.limit(0)).collect() == []


def test_windows_of_blocks(spark, monkeypatch):
    from exonia.operators import counting

    monkeypatch.setattr(counting, "WINDOW_BLOCK", 7)
    texts = ["ACGTTGCAACGTACGGTNACGTACGTTTACG", "ACG", "AC", "", None, "ACGTACGTA", "ACGTACGTAC"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    got = sorted((r.i, r._w) for r in counting.windows(df, counting.F.col("s"), 3).collect())
    assert got == sorted((i, t[j : j + 3]) for i, t in enumerate(texts) if t for j in range(len(t) - 2))
