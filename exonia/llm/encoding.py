"""Problem 6: encoding a corpus with a public tokenizer, and decoding it.

Method: a distinct-word table. Texts are cut into words in Spark tasks and written once, in blocks of about a million words,
as compressed numbers into each block's own list of distinct words. The lists of all blocks make the table of distinct words, each of
which is encoded once; an equi-join on the word gives every block the tokens of its list, and the block's numbers put them
back by position. Decoding is the same with an id-to-piece join. No task holds more than some blocks, whatever the corpus'
size, and no word list is broadcast."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from exonia.llm.words import WordEncoder, character_classes, class_table, cut_words, ranks, text_slices, vocabulary_path
from exonia.session import stored

#: Words (or tokens) of one block; a longer text is a block of its own.
BLOCK_WORDS = 1_000_000
#: How blocks are written. A reader takes up to 4096 rows of a row group at once, and a writer looks at its size first after
#: 100 rows; a block is a row of megabytes, so row groups are kept small and are measured after every row.
ROW_GROUPS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1"}


def _number_type(distinct: int) -> type:
    return np.uint16 if distinct <= 1 << 16 else np.int32


def _packed(codes: pa.Array, distinct: int) -> bytes:
    """Numbers below `distinct` as compressed bytes: an eighth to a third of what they take as an array of a row."""
    if codes.null_count:
        raise ValueError("a list has a null item")
    return pa.compress(codes.to_numpy().astype(_number_type(distinct)), codec="zstd", asbytes=True)


def _unpacked(packed: pa.BinaryScalar, n: int, distinct: int) -> pa.Array:
    kind = np.dtype(_number_type(distinct))
    return pa.array(np.frombuffer(pa.decompress(packed.as_buffer(), n * kind.itemsize, codec="zstd"), kind) if n else np.zeros(0, kind))


def _block(ids: list, firsts: list, items: list) -> pa.RecordBatch:
    """One block as a row: its rows' ids, how many items each has, the items as packed numbers, and the distinct items."""
    flat = pa.chunked_array(items).combine_chunks().dictionary_encode()
    counts = np.concatenate([np.diff(f) for f in firsts]).astype(np.int32)
    row = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    return pa.RecordBatch.from_arrays(
        [row(pa.concat_arrays(ids)), row(pa.array(counts)), pa.array([_packed(flat.indices, len(flat.dictionary))], pa.binary()), row(flat.dictionary)],
        ["ids", "counts", "codes", "items"],
    )


def _blocks_of(parts, block_words: int):
    """Gathers (ids, firsts, items) until a block is full."""
    held: list[list] = [[], [], []]
    n = 0
    for part in parts:
        for x, y in zip(held, part, strict=True):
            x.append(y)
        n += len(part[2])
        if n >= block_words:
            yield _block(*held)
            held, n = [[], [], []], 0
    if held[0]:
        yield _block(*held)


def _stored_blocks(rows: DataFrame, cut, item: str, name: str) -> DataFrame:
    """(block, ids, counts, codes, items) of the rows, numbered and written once to the shared folder."""
    key = rows.schema[0].dataType.simpleString()
    made = rows.mapInArrow(cut, f"ids array<{key}>, counts array<int>, codes binary, items array<{item}>")
    return stored(made.select(F.monotonically_increasing_id().alias("block"), "*"), name, ROW_GROUPS)


def word_blocks(texts: DataFrame, doc_id: str, text: str, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(block, ids, counts, codes, items) of the texts, written once to the shared folder."""
    runs = character_classes()

    def cut(batches):
        table = class_table(runs)

        def parts():
            for b in batches:
                for lo, hi in text_slices(b.column(1)):
                    got = cut_words(b.column(1).slice(lo, hi - lo), table)
                    yield b.column(0).slice(lo, hi - lo), got.firsts, got.words

        yield from _blocks_of(parts(), block_words)

    return _stored_blocks(texts.select(doc_id, text), cut, "string", "words")


def id_blocks(encoded: DataFrame, doc_id: str, ids: str, block_words: int = BLOCK_WORDS) -> DataFrame:
    """As word_blocks, of lists of token ids."""

    def cut(batches):
        def parts():
            for b in batches:
                lists = b.column(1)
                flat = lists.flatten()
                counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
                firsts = np.append(0, np.cumsum(counts, dtype=np.int64))
                lo = 0
                while lo < len(lists):
                    hi = max(lo + 1, int(np.searchsorted(firsts, firsts[lo] + block_words, "right")) - 1)
                    yield b.column(0).slice(lo, hi - lo), firsts[lo : hi + 1] - firsts[lo], flat.slice(firsts[lo], firsts[hi] - firsts[lo])
                    lo = hi

        yield from _blocks_of(parts(), block_words)

    return _stored_blocks(encoded.select(doc_id, ids), cut, "int", "ids")


def _filled(batches, empty: pa.DataType):
    """(ids, values, firsts) of each block of _put_back's batches: the value of every item, and where each row's items begin
    and the last one's end."""
    for b in batches:
        for r in range(b.num_rows):
            ids, counts, values = (b.column(i).slice(r, 1).flatten() for i in (1, 2, 4))
            firsts = np.append(0, np.cumsum(counts.to_numpy(), dtype=np.int64))
            yield ids, values.take(_unpacked(b.column(3)[r], int(firsts[-1]), len(values))) if firsts[-1] else pa.array([], empty), firsts


def _put_back(blocks: DataFrame, listed: DataFrame, value: str) -> DataFrame:
    """blocks with `values`, what `listed` (block, nth, value) has for each entry of its list, in the list's order."""
    # Only entries are gathered here, at most as many as the block's list has.
    own = listed.groupBy("block").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", value))), lambda x: x[value]).alias("values"))
    return blocks.select("block", "ids", "counts", "codes").join(own, "block", "left")


def _entries(blocks: DataFrame) -> DataFrame:
    return blocks.select("block", F.posexplode("items").alias("nth", "item"))


def word_table(words: DataFrame, path: str) -> DataFrame:
    """(item, tokens): the token ids of each distinct word."""

    def encode(batches):
        encoder = WordEncoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encoder.ids(w) for w in b.column(0).to_pylist()], pa.list_(pa.int32()))], ["item", "tokens"])

    return words.select("item").distinct().mapInArrow(encode, "item string, tokens array<int>")


def encoded(texts: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", path: str | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, ids): the token ids of every row's text, without special tokens; a text that looks like one is plain text.

    Null and empty texts have an empty list. Rows that repeat, also with the same or a null id, come out as often as they
    are there; an empty table gives an empty one. tokenizer: a byte-level tokenizer of public_tokenizers; path: its rank
    file, where it lies elsewhere."""
    blocks = word_blocks(texts, doc_id, text, block_words)
    entries = _entries(blocks)
    listed = entries.join(word_table(entries, path or vocabulary_path(tokenizer)), "item")

    def fill(batches):
        for ids, lists, firsts in _filled(batches, pa.list_(pa.int32())):
            rows = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64))[firsts]
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(rows, pa.int32()), lists.flatten())], [doc_id, "ids"])

    key = texts.schema[doc_id].dataType.simpleString()
    return _put_back(blocks, listed, "tokens").mapInArrow(fill, f"{doc_id} {key}, ids array<int>")


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """(item, piece): the bytes of each token id; as many rows as the vocabulary has, a fixed number."""
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("piece", T.BinaryType())])
    return spark.createDataFrame([(i, bytearray(p)) for p, i in ranks(path).items()], schema)


def decoded(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", tokenizer: str = "byte_bpe_50k", path: str | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, text): the texts that lists of token ids stand for. Null and empty lists give an empty text; bytes that
    are no valid UTF-8 give replacement characters; an id outside the vocabulary fails."""
    blocks = id_blocks(encoded, doc_id, ids, block_words)
    pieces = piece_table(encoded.sparkSession, path or vocabulary_path(tokenizer))
    listed = _entries(blocks).join(F.broadcast(pieces), "item", "left").withColumn("piece", F.coalesce("piece", F.raise_error(F.concat(F.lit("no such token id: "), "item")).cast("binary")))

    def fill(batches):
        for keys, pieces, firsts in _filled(batches, pa.binary()):
            rows = np.append(0, np.cumsum(pc.binary_length(pieces).to_numpy(zero_copy_only=False), dtype=np.int64))[firsts]
            body = pieces.buffers()[2]
            body = body.to_pybytes() if body is not None else b""
            yield pa.RecordBatch.from_arrays([keys, pa.array([body[x:y].decode("utf-8", "replace") for x, y in zip(rows[:-1], rows[1:], strict=True)], pa.string())], [doc_id, "text"])

    key = encoded.schema[doc_id].dataType.simpleString()
    return _put_back(blocks, listed, "piece").mapInArrow(fill, f"{doc_id} {key}, text string")
