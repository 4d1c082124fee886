"""Pieces: sizes, overlaps, boundaries, and merging against a plain search."""

import random

import pytest
from exonia.llm import cutting
from exonia.llm.words import WordEncoder, vocabulary_path

SCHEMA = "doc_id long, text string"
SRT = "".join(f"{i}\n00:00:{i % 60:02},000 --> 00:00:{i % 60:02},900\nLine one of cue {i}. And more\nand line two!\n\n" for i in range(1, 120))
FRAMES = "".join(f"{{{i}}}{{{i + 9}}}One thing|and another.\r\n" for i in range(0, 900, 10))
TEXTS = [None, "", "short", SRT, SRT.replace("\n", "\r\n"), FRAMES, "x" * 900 + " " + "y" * 900, "中文字" * 300, "😀" * 400, " " * 500 + "\n" * 300, "One. Two! Three? " * 90, SRT]


def plain_merge(sizes, strength, room):
    """Merges the weakest pair by looking at all of them each time."""
    at = list(range(len(sizes)))
    sizes = list(sizes)
    while True:
        best = min(((strength[at[k]], sizes[k - 1] + sizes[k], at[k], k) for k in range(1, len(at)) if sizes[k - 1] + sizes[k] <= room), default=None)
        if best is None:
            return at
        k = best[3]
        sizes[k - 1] += sizes.pop(k)
        at.pop(k)


def test_merging_is_that_of_a_plain_search():
    r = random.Random(4)
    for _ in range(300):
        n = r.randint(1, 25)
        sizes, strength = [r.randint(1, 20) for _ in range(n)], [r.randint(0, 5) for _ in range(n)]
        assert cutting.merged(sizes, strength, 40) == plain_merge(sizes, strength, 40)


@pytest.mark.parametrize(("capacity", "overlap"), [(40, 0), (40, 12), (64, 8), (9, 5), (512, 64)])
def test_pieces(spark, capacity, overlap):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], SCHEMA + ", piece int").repartition(2)
    out = cutting.pieces(docs, [(1, "byte_bpe_50k", capacity, overlap)]).toPandas().sort_values(["doc_id", "piece"])
    encoding = WordEncoder(vocabulary_path("byte_bpe_50k")).encoding
    for i, text in enumerate(TEXTS):
        ids = encoding.encode_ordinary(text or "")
        own = out[out["doc_id"] == i]
        if len(ids) <= capacity:
            assert not len(own)
            continue
        assert list(own["piece"]) == list(range(len(own)))
        assert own["n_tokens"].max() <= capacity
        end = char_end = 0
        for p in own.itertuples():
            assert p.tok_start + p.n_shared == end
            assert p.n_shared == (min(overlap, end) if p.piece else 0)
            end = p.tok_start + p.n_tokens
            slice_text = encoding.decode_bytes(ids[p.tok_start : end]).decode("utf-8", "ignore")
            assert slice_text in p.text and len(p.text) - len(slice_text) <= 2
            assert text[p.char_start : p.char_start + len(p.text)] == p.text
            assert p.char_start <= char_end
            char_end = p.char_start + len(p.text)
        assert end == len(ids) and char_end == len(text)


def test_cuts_lie_between_cues_where_these_fit(spark):
    docs = spark.createDataFrame([(1, SRT), (2, SRT.replace("\n", "\r\n")), (3, FRAMES)], SCHEMA)
    out = cutting.pieces(docs, [(1, "byte_bpe_50k", 200, 0)])
    assert {r.boundary for r in out.where("piece > 0").collect()} == {"cue"}
    assert all(r.text[0].isdigit() for r in out.where("doc_id < 3").collect())
    assert {r.boundary for r in cutting.pieces(spark.createDataFrame([(1, "One two. " * 200)], SCHEMA), [(1, "byte_bpe_50k", 50, 0)]).where("piece > 0").collect()} == {"sentence"}
    assert {r.boundary for r in cutting.pieces(spark.createDataFrame([(1, "one two " * 200)], SCHEMA), [(1, "byte_bpe_50k", 50, 0)]).where("piece > 0").collect()} == {"word"}
    assert {r.boundary for r in cutting.pieces(spark.createDataFrame([(1, "one two\n" * 200)], SCHEMA), [(1, "byte_bpe_50k", 50, 0)]).where("piece > 0").collect()} == {"line"}


def test_limits(spark):
    docs = spark.createDataFrame([(1, SRT), (None, SRT), (1, SRT)], SCHEMA)
    out = cutting.pieces(docs, [(1, "byte_bpe_50k", 100, 0), (2, "byte_bpe_50k", 200, 10)])
    one = cutting.pieces(docs.limit(1), [(1, "byte_bpe_50k", 100, 0), (2, "byte_bpe_50k", 200, 10)])
    assert out.count() == 3 * one.count()
    assert cutting.pieces(docs.limit(0), [(1, "byte_bpe_50k", 100, 0)]).collect() == []
    with pytest.raises(ValueError):
        cutting.pieces(docs, [(1, "byte_bpe_50k", 10, 8)])
