"""Words, encoding and decoding against the tokenizer itself."""

import glob
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Row

regex = pytest.importorskip("regex")
P = pytest.importorskip("public_tokenizers")

from exonia.llm import encoding, sizes, words  # noqa: E402

TEXTS = [
    None, "", " ", "  \n ", "'s", "a's b", "''s 's", "don't'll 've  'd\n't", "x\n\n\ny", "x \n y", "!'s", "😀😀 x😀", "it'", "l'été", "\n'sabc", "'sabc're",
    "中文字 12３", "a\r\n\r\nb", "'r", "<|endoftext|> plain", "a<|endoftext|>", "q" * 5000, "  　x", "1\n00:00:05,420 --> 00:00:11,133\nYou?\n\n2\n",
    "ab " * 20000, "́e‍",
]
SCHEMA = "doc_id long, text string"


def reference():
    import tokenizers

    t = tokenizers.Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def random_texts(n, seed=5):
    r = random.Random(seed)
    alphabet = ["a", "B", "é", "ж", "中", "1", "٣", "²", " ", " ", "\n", "\r", "\t", " ", " ", "'", "'", "s", "t", "r", "e", "l", "v", "!", "-", "😀", "_", "́"]
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_words_are_those_of_the_pattern():
    table = words.class_table(words.character_classes())
    pattern = regex.compile(P.PATTERN)
    texts = TEXTS + random_texts(4000)
    column = pa.array(texts, pa.string())
    assert list(words.text_slices(pa.array([], pa.string()))) == []
    for lo, hi in words.text_slices(column):
        cut = words.cut_words(column.slice(lo, hi - lo), table)
        got = cut.words.to_pylist()
        for k in range(lo, hi):
            assert got[cut.firsts[k - lo] : cut.firsts[k - lo + 1]] == pattern.findall(texts[k] or "")


def test_slices_of_one_long_text_each(monkeypatch):
    monkeypatch.setattr(words, "SLICE_BYTES", 10)
    column = pa.array(["a" * 30, None, "b", "c" * 30], pa.string())
    assert list(words.text_slices(column)) == [(0, 1), (1, 3), (3, 4)]


@pytest.mark.parametrize("block_words", [1, 50, 1_000_000])
def test_encoding_is_the_tokenizers(spark, block_words):
    texts = TEXTS + random_texts(300)
    docs = spark.createDataFrame([Row(doc_id=i, text=t, ids="clash", block=1) for i, t in enumerate(texts)], SCHEMA + ", ids string, block int").repartition(3)
    got = {r.doc_id: r.ids for r in encoding.encoded(docs, block_words=block_words).collect()}
    encode = reference()
    assert got == {i: encode(t) for i, t in enumerate(texts)}


def test_repeated_rows_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (None, None)], SCHEMA)
    assert sorted(len(r.ids) for r in encoding.encoded(docs).collect()) == [0, 2, 2, 2]
    assert encoding.encoded(docs.limit(0)).collect() == []
    assert encoding.decoded(encoding.encoded(docs.limit(0))).collect() == []
    assert encoding.encoded(spark.createDataFrame([(1, None), (2, "")], SCHEMA)).where("size(ids) = 0").count() == 2


def test_decoding_is_the_inverse(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], SCHEMA)
    got = {r.doc_id: r.text for r in encoding.decoded(encoding.encoded(docs), block_words=70).collect()}
    assert got == {i: t or "" for i, t in enumerate(TEXTS)}
    ids = spark.createDataFrame([(1, None), (2, []), (3, [0, 1])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in encoding.decoded(ids).collect()} == {1: "", 2: "", 3: '!"'}
    with pytest.raises(Exception, match="no such token id"):
        encoding.decoded(spark.createDataFrame([(1, [50256])], "doc_id long, ids array<int>")).collect()


def test_the_other_vocabulary(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], SCHEMA)
    ids = encoding.encoded(docs, tokenizer="byte_bpe_multi_50k")
    assert {r.doc_id: r.text for r in encoding.decoded(ids, tokenizer="byte_bpe_multi_50k").collect()} == {i: t or "" for i, t in enumerate(TEXTS)}


def test_blocks_are_small_rows_in_small_row_groups(spark, tmp_path):
    r = random.Random(7)
    texts = ["".join(r.choices("abcdefghijklmnop", k=1 << 20)) for _ in range(40)]
    pq.write_table(pa.table({"doc_id": range(40), "text": texts}), tmp_path / "long.parquet")
    blocks = encoding.word_blocks(spark.read.parquet(str(tmp_path)).coalesce(1), "doc_id", "text", block_words=1)
    groups = [g for f in glob.glob(f"{blocks._stored_in}/*.parquet") for m in [pq.read_metadata(f)] for g in map(m.row_group, range(m.num_row_groups))]
    assert sum(g.num_rows for g in groups) == blocks.select("block").distinct().count() > 4
    assert max(g.total_byte_size for g in groups) <= 24 << 20 < sum(g.total_byte_size for g in groups)
    blocks = encoding.word_blocks(spark.createDataFrame([(1, "".join(r.choices([" aa", " b", " c", " dd"], k=200_000)))], SCHEMA), "doc_id", "text")
    assert [len(x.codes) < 100_000 for x in blocks.collect()] == [True]
    with pytest.raises(Exception, match="null item"):
        encoding.decoded(spark.createDataFrame([(1, [0, None])], "doc_id long, ids array<int>")).collect()


def test_more_words_than_sixteen_bits_count(spark):
    named = [" " + "".join(chr(97 + n // 26**k % 26) for k in range(4)) for n in range(70_000)]
    docs = spark.createDataFrame([(1, "".join(named)), (2, "".join(named[::-1]))], SCHEMA).coalesce(1)
    ids = encoding.encoded(docs)
    encode = reference()
    assert {x.doc_id: x.ids for x in ids.collect()} == {1: encode("".join(named)), 2: encode("".join(named[::-1]))}
    assert {x.doc_id: x.text for x in encoding.decoded(ids).collect()} == {1: "".join(named), 2: "".join(named[::-1])}


def test_sizes(spark):
    encode = reference()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], SCHEMA)
    assert {r.doc_id: r.n_tokens for r in sizes.token_sizes(docs, ["doc_id"]).collect()} == {i: len(encode(t)) for i, t in enumerate(TEXTS)}


def test_kept_words_are_bounded(monkeypatch):
    monkeypatch.setattr(words.WordEncoder, "KEPT", 3)
    e = words.WordEncoder(words.vocabulary_path("byte_bpe_50k"))
    assert [e.size(w) for w in "a b c d a".split()] == [1] * 5 and len(e.sizes) <= 3
    assert np.array_equal(e.ids("a"), reference()("a"))
