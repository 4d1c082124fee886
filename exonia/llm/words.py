"""Words of texts, as a byte-level tokenizer sees them, and the tokens of each word.

Both byte-level vocabularies cut a text by the same rule before they merge bytes: contractions, runs of letters, of digits
and of other characters, each with one blank before it, and runs of white space. A word's tokens depend on nothing else,
so each distinct word is encoded once. All functions here run inside tasks, on one Arrow batch."""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

OTHER, LETTER, NUMBER, WHITE = range(4)
#: The characters with the property White_Space, and the contractions.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SHORT, LONG = ("s", "t", "m", "d"), ("re", "ve", "ll")
#: Bytes of text that are cut at a time.
SLICE_BYTES = 4 << 20


def character_classes() -> tuple[np.ndarray, np.ndarray]:
    """(first code point, class) of each run of code points of one class; made once on the driver."""
    kinds = np.zeros(0x110000, np.uint8)
    by = {"L": LETTER, "N": NUMBER}
    kinds[:] = [by.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)]
    kinds[WHITE_SPACE] = WHITE
    first = np.flatnonzero(np.diff(kinds, prepend=255))
    return first, kinds[first]


def class_table(runs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    first, kind = runs
    return np.repeat(kind, np.diff(first, append=0x110000))


class Cut(NamedTuple):
    words: pa.Array  # of all texts of the slice, one after the other
    firsts: np.ndarray  # number of the first word of each text, and the number of words


def text_slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about SLICE_BYTES of text each; a longer text is alone."""
    sizes = np.diff(_offsets(column))
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > SLICE_BYTES:
            yield start, i
            start, held = i, 0
        held += n
    if len(sizes):
        yield start, len(sizes)


def _offsets(column: pa.Array) -> np.ndarray:
    """The offsets of a text column; a null text is as long as an empty one."""
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    raw = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1]
    return raw.astype(np.int64)


def cut_words(column: pa.Array, table: np.ndarray) -> Cut:
    """The words of a slice of a text column; null and empty texts have none."""
    offsets = _offsets(column)
    base, size = offsets[0], int(offsets[-1] - offsets[0])
    if not size:
        return Cut(pa.array([], pa.string()), np.zeros(len(column) + 1, np.int64))
    body = np.frombuffer(column.buffers()[2], np.uint8, size, base)
    offsets = offsets - base
    at = np.flatnonzero((body & 0xC0) != 0x80).astype(np.int32)
    lead = body[at]
    kind = table[lead].copy()
    wide = np.flatnonzero(lead >= 0x80)
    if len(wide):
        kind[wide] = table[_code_points(body, at[wide])]
    n = len(at)
    doc_first = np.searchsorted(at, offsets[:-1]).astype(np.int64)  # of an empty text: where the next one begins
    opens = np.zeros(n + 1, bool)
    opens[doc_first] = True
    opens = opens[:n]
    before = np.empty(n, np.uint8)
    before[0], before[1:] = 255, kind[:-1]
    before[opens] = 255
    start = kind != before
    # A word takes one blank before it; other white space before it ends with a word of one character.
    after_white = np.flatnonzero(start & (kind != WHITE) & (before == WHITE))
    start[after_white - 1] = True
    start[after_white[lead[after_white - 1] == 32]] = False
    # Contractions are words of their own where an apostrophe would begin one.
    quote = np.flatnonzero((lead == 39) & start)
    if len(quote):
        last = np.append(doc_first[1:], n)[np.searchsorted(doc_first, quote, "right") - 1]  # end of the quote's text
        ahead = lambda k: np.where(quote + k < last, lead[np.minimum(quote + k, n - 1)], 0)
        one, two = ahead(1), ahead(2)
        length = np.where(np.isin(one, [ord(c) for c in SHORT]), 2, 0)
        for a, b in LONG:
            length[(one == ord(a)) & (two == ord(b))] = 3
        quote, length, last = quote[length > 0], length[length > 0], last[length > 0]
        start[quote + 1] = False
        start[(quote + length)[quote + length < last]] = True
    begin = np.flatnonzero(start)
    ends = np.append(at[begin], size).astype(np.int32)
    words = pa.StringArray.from_buffers(len(begin), pa.py_buffer(ends), pa.py_buffer(body))
    return Cut(words, np.append(np.searchsorted(begin, doc_first), len(begin)))


def _code_points(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    padded = np.append(body, np.zeros(3, np.uint8))
    b0, b1, b2, b3 = (padded[at + k].astype(np.int32) for k in range(4))
    two = (b0 & 0x1F) << 6 | b1 & 0x3F
    three = (b0 & 0x0F) << 12 | (b1 & 0x3F) << 6 | b2 & 0x3F
    four = (b0 & 0x07) << 18 | (b1 & 0x3F) << 12 | (b2 & 0x3F) << 6 | b3 & 0x3F
    return np.where(b0 < 0xE0, two, np.where(b0 < 0xF0, three, np.minimum(four, 0x10FFFF)))


def vocabulary_path(tokenizer: str) -> str:
    """The rank file of one of the public byte-level tokenizers."""
    import public_tokenizers

    return str(public_tokenizers.path(f"{tokenizer}.tiktoken"))


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class WordEncoder:
    """Encodes single words; those seen are kept, up to a number after which they are forgotten."""

    KEPT = 300_000

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self.encoding = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})
        self.sizes: dict[str, int] = {}

    def ids(self, word: str) -> list[int]:
        return self.encoding.encode_ordinary(word)

    def size(self, word: str) -> int:
        n = self.sizes.get(word)
        if n is None:
            if len(self.sizes) >= self.KEPT:
                self.sizes.clear()
            n = self.sizes[word] = len(self.ids(word))
        return n
