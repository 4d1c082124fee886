"""Problem 8: splitting oversized texts at natural boundaries.

Method: agglomerative merging. A text is taken apart into atomic segments, and adjacent pairs are held in a heap; the pair
with the weakest boundary is merged first (of equal boundaries the smaller pair) while its size plus the overlap fits.

Atoms are the coarsest natural segments that fit (cues, else lines, sentences, words, parts of words): a heap that began
with finer ones would first merge them back to these, as the boundaries inside a segment are weaker than those around it."""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from exonia.llm.sizes import word_sizes
from exonia.llm.words import WordEncoder, character_classes, class_table, cut_words, text_slices, vocabulary_path

#: What lies before a piece, from the weakest boundary to the strongest; `text` begins a text.
BOUNDARIES = ("token", "joint", "word", "sentence", "line", "cue", "text")
TOKEN, JOINT, WORD, SENTENCE, LINE, CUE, TEXT = range(7)
_SENTENCE_END = re.compile("[.!?…。！？؟]+[\"'”’»)\\]<]*$")


def boundary_strengths(distinct: list[str], codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The strength of the boundary before each word. White space belongs to what comes before it: before a word of white
    space there is only a joint. A blank line, or a line that begins with a frame number in braces, begins a cue."""
    of = lambda f, kind: np.array([f(w) for w in distinct], kind)[codes] if distinct else np.zeros(0, kind)
    white = of(str.isspace, bool)
    newlines = of(lambda w: w.count("\n") + w.count("\r") - w.count("\r\n") if w.isspace() else 0, np.int64)
    spaced, brace = of(lambda w: w[0].isspace(), bool), of(lambda w: w.lstrip(" ")[:1] == "{", bool)
    ends, bar = of(lambda w: bool(_SENTENCE_END.search(w)), bool), of(lambda w: w[-1] == "|", bool)
    n = len(codes)
    index = np.arange(n)
    # The last word before this one that isn't white space, and the line ends since.
    solid = np.maximum.accumulate(np.where(white, -1, index)) if n else index
    last = np.append(-1, solid[:-1])[:n]
    upto = np.append(0, np.cumsum(newlines))
    lines = upto[:n] - upto[last + 1]
    # "\r\n" may be cut into two words.
    cr, lf = of(lambda w: w[-1] == "\r" and w.isspace(), bool), of(lambda w: w[0] == "\n", bool)
    halves = np.append(0, np.cumsum(np.append(False, cr[:-1] & lf[1:])[:n]))
    lines = lines - (halves[:n] - halves[last + 1])
    gap = spaced | (last < index - 1)
    at = np.maximum(last, 0)
    out = np.full(n, JOINT, np.int8)
    out[gap] = WORD
    out[gap & ends[at]] = SENTENCE
    out[(lines > 0) | bar[at]] = LINE
    out[(lines > 1) | (lines > 0) & brace] = CUE
    out[white] = JOINT
    out[firsts[:-1][firsts[:-1] < n]] = TEXT
    return out


def merged(sizes: list[int], strength: list[int], room: int) -> list[int]:
    """The first segments of the pieces that merging gives; strength[k] is that of the boundary before segment k."""
    n = len(sizes)
    size, left, right = sizes[:], list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(strength[k], t, k) for k in range(1, n) if (t := size[k - 1] + size[k]) <= room]
    heapify(heap)
    alive = [True] * n
    while heap:
        _, total, k = heappop(heap)
        if not alive[k] or size[a := left[k]] + size[k] != total:
            continue
        size[a], alive[k] = total, False
        after = right[a] = right[k]
        if after < n:
            left[after] = a
            if (t := total + size[after]) <= room:
                heappush(heap, (strength[after], t, after))
        if (p := left[a]) >= 0 and (t := size[p] + total) <= room:
            heappush(heap, (strength[a], t, a))
    return [k for k in range(n) if alive[k]]


class _Slice:
    """The words of a slice of texts with sizes and boundaries; cuts its texts for one limit."""

    def __init__(self, encoder: WordEncoder, column: pa.Array, table: np.ndarray):
        self.encoder, self.column = encoder, column
        cut = cut_words(column, table)
        self.firsts = cut.firsts
        self.sizes, self.codes, self.distinct = word_sizes(encoder, cut.words)
        self.strength = boundary_strengths(self.distinct, self.codes, self.firsts)
        self.tokens = np.append(0, np.cumsum(self.sizes, dtype=np.int64))
        chars = np.array([len(w) for w in self.distinct], np.int64)[self.codes] if self.distinct else np.zeros(0, np.int64)
        self.chars = np.append(0, np.cumsum(chars))

    def inside(self, word: int) -> list[tuple[int, int, int]]:
        """(tokens before, characters before, 0 or 1) for each token of a word; 1: the token begins a character."""
        out, tokens, chars = [], 0, 0
        for i in self.encoder.ids(self.distinct[self.codes[word]]):
            piece = self.encoder.encoding.decode_single_token_bytes(i)
            whole = (piece[0] & 0xC0) != 0x80
            out.append((tokens, chars - (not whole), int(whole)))
            tokens += 1
            chars += sum((b & 0xC0) != 0x80 for b in piece)
        return out

    def place(self, token: int) -> int:
        """The character in which a token begins."""
        word = int(np.searchsorted(self.tokens, token, "right")) - 1
        skip = token - int(self.tokens[word])
        return int(self.chars[word]) + (self.inside(word)[skip][1] if skip else 0)

    def atoms(self, capacity: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first token, character, strength) of the atoms of the texts above the capacity, in order."""
        room = capacity - overlap
        per_doc = np.diff(self.tokens[self.firsts])
        big = np.repeat(per_doc > capacity, np.diff(self.firsts))
        begin = big & (self.strength == TEXT)
        for level in (CUE, LINE, SENTENCE, WORD, JOINT):
            at = np.flatnonzero(begin)
            if not len(at):
                break
            ends = np.append(at[1:], len(big))
            size = self.tokens[ends] - self.tokens[at]
            # A segment runs on to the next text above the capacity; what lies between belongs to none.
            owner = np.repeat(np.arange(len(at)), ends - at)
            over = np.zeros(len(big), bool)
            over[at[0] :] = (size > room)[owner]
            begin |= big & over & (self.strength == level)
        at = np.flatnonzero(begin)
        first, char, strength = self.tokens[at], self.chars[at], self.strength[at].astype(np.int64)
        wide = at[(self.sizes[at] > room)]
        if len(wide):
            more = [(self.tokens[w] + t, self.chars[w] + c, TOKEN) for w in wide for t, c, whole in self.inside(w) if t and whole]
            if more:
                extra = np.array(more, np.int64)
                first, char, strength = (np.concatenate([a, b]) for a, b in zip((first, char, strength), extra.T, strict=True))
                order = np.argsort(first, kind="stable")
                first, char, strength = first[order], char[order], strength[order]
        return first, char, strength

    def pieces(self, limit_id: int, capacity: int, overlap: int):
        """(row, limit_id, piece, tok_start, n_tokens, n_shared, char_start, boundary, text) of each piece."""
        first, char, strength = self.atoms(capacity, overlap)
        if not len(first):
            return
        heads = np.flatnonzero(strength == TEXT)
        rows = np.searchsorted(self.tokens[self.firsts], first[heads], "right") - 1
        for row, lo, hi in zip(rows.tolist(), heads.tolist(), np.append(heads[1:], len(first)).tolist(), strict=True):
            base, end = int(self.tokens[self.firsts[row]]), int(self.tokens[self.firsts[row + 1]])
            zero, text = int(self.chars[self.firsts[row]]), self.column[row].as_py()
            starts = [*first[lo:hi].tolist(), end]
            kinds = strength[lo:hi].tolist()
            keep = merged([b - a for a, b in zip(starts[:-1], starts[1:], strict=True)], kinds, capacity - overlap)
            stops = [(starts[k], int(char[lo + k]) - zero) for k in keep[1:]] + [(end, len(text))]
            for piece, (k, (stop, char_stop)) in enumerate(zip(keep, stops, strict=True)):
                shared = min(overlap, starts[k] - base) if piece else 0
                begin = starts[k] - shared
                char_start = (self.place(begin) if shared else int(char[lo + k])) - zero
                yield row, limit_id, piece, begin - base, stop - begin, shared, char_start, BOUNDARIES[kinds[k]], text[char_start:char_stop]


FIELDS = ("limit_id int", "piece int", "tok_start int", "n_tokens int", "n_shared int", "char_start int", "boundary string", "text string")
_ARROW = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())


def pieces(docs: DataFrame, limits: list[tuple[int, str, int, int]], doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, limit_id, piece, tok_start, n_tokens, n_shared, char_start, boundary, text) for each limit (limit_id,
    tokenizer, capacity, overlap): the pieces, counted from 0, of each text with more tokens than the capacity.

    Sizes are in tokens of the whole text's encoding, of which a piece is the range of n_tokens from tok_start, with the
    characters from char_start. n_tokens is at most the capacity; every piece but the first shares its first n_shared
    tokens with the one before, which is the overlap, or less where the text has less before the cut. boundary is what the
    piece's own part begins at. Where a shared range begins inside a character, the text has the whole character; so it
    has where a cut must fall inside a word. Without the shared ranges the pieces are the text. Null, empty and small
    texts give no rows; repeated rows give their pieces again. A capacity must exceed its overlap by 4 at least, so that
    any character fits."""
    for i, _, capacity, overlap in limits:
        if overlap < 0 or capacity - overlap < 4:
            raise ValueError(f"limit {i}: a capacity of {capacity} is too small for an overlap of {overlap}")
    runs = character_classes()
    key = docs.schema[doc_id].dataType.simpleString()
    out = None
    for tokenizer in sorted({t for _, t, _, _ in limits}):
        own = [(i, c, o) for i, t, c, o in limits if t == tokenizer]
        ranks_at = path or vocabulary_path(tokenizer)

        def cut(batches, own=own, ranks_at=ranks_at):
            table, encoder = class_table(runs), WordEncoder(ranks_at)
            names = [doc_id, *(f.split(" ")[0] for f in FIELDS)]
            for b in batches:
                for lo, hi in text_slices(b.column(1)):
                    part = _Slice(encoder, b.column(1).slice(lo, hi - lo), table)
                    for limit in own:
                        got = list(zip(*part.pieces(*limit), strict=True))
                        if got:
                            ids = b.column(0).slice(lo, hi - lo).take(pa.array(got[0], pa.int32()))
                            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(got[1:], _ARROW, strict=True))], names)

        cuts = docs.select(doc_id, text).mapInArrow(cut, f"`{doc_id}` {key}, {', '.join(FIELDS)}")
        out = cuts if out is None else out.unionByName(cuts)
    if out is None:
        raise ValueError("no limits")
    return out
