"""Sizes of texts in tokens."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from exonia.llm.words import WordEncoder, character_classes, class_table, cut_words, text_slices, vocabulary_path


def word_sizes(encoder: WordEncoder, words: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(tokens of each word, its number among the distinct words, the distinct words)."""
    coded = words.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    sizes = np.fromiter(map(encoder.size, distinct), np.int32, len(distinct))
    return sizes[codes] if len(codes) else np.zeros(0, np.int32), codes, distinct


def token_sizes(texts: DataFrame, keep: list[str], text: str = "text", tokenizer: str = "byte_bpe_50k", path: str | None = None) -> DataFrame:
    """(keep..., n_tokens): the number of tokens of each row's text; 0 for null and empty texts."""
    runs = character_classes()
    path = path or vocabulary_path(tokenizer)

    def count(batches):
        table, encoder = class_table(runs), WordEncoder(path)
        for b in batches:
            column = b.column(len(keep))
            for lo, hi in text_slices(column):
                cut = cut_words(column.slice(lo, hi - lo), table)
                sizes, _, _ = word_sizes(encoder, cut.words)
                upto = np.append(0, np.cumsum(sizes, dtype=np.int64))[cut.firsts]
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(lo, hi - lo) for i in range(len(keep))), pa.array(np.diff(upto).astype(np.int32))], [*keep, "n_tokens"])

    kinds = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keep)
    return texts.select(*keep, text).mapInArrow(count, f"{kinds}, n_tokens int")
