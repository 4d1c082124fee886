"""Nucleotides, codons and residues as Column expressions.

Nucleotide indices are A 0, G 1, C 2, T 3; a codon's index is 16 * first + 4 * second + third. Coordinates are 0-based and
end-exclusive. Sequences are upper-case ASCII, as BINARY where they are long (a slice of BINARY doesn't walk the text)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nucleotides in index order, complements, and the standard genetic code in the order T, C, A, G.
NUCLEOTIDES = "AGCT"
COMPLEMENT = ("ACGTRYKMBVDH", "TGCAYRMKVBHD")
STANDARD_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODE_ORDER = "TCAG"
RESIDUES = "ABCDEFGHIKLMNPQRSTVWXYZ*-."
#: Strands on which a gene is read from high to low positions; "." counts as forward.
REVERSE = "-"


def code_by_index(code: str = STANDARD_CODE, order: str = CODE_ORDER) -> str:
    """A genetic code given in some order of nucleotides, as residues by codon index."""
    place = [order.index(n) for n in NUCLEOTIDES]
    return "".join(code[16 * place[a] + 4 * place[b] + place[c]] for a in range(4) for b in range(4) for c in range(4))


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dna(text: Column | str) -> Column:
    """Raw sequence text as DNA: upper case, U as T, X and everything unknown as N."""
    t = F.translate(F.upper(_c(text)), "UX", "TN")
    return F.regexp_replace(t, "[^ACGTRYKMBVDHWSN]", "N")


def dna_slice(seq: Column | str, start: Column, end: Column) -> Column:
    """[start, end) of a BINARY or STRING sequence; where start >= end the reverse complement of [end, start)."""
    lo, hi = F.least(start, end), F.greatest(start, end)
    part = F.substring(_c(seq), lo + 1, hi - lo).cast("string")
    return F.when(start < end, part).otherwise(reverse_complement(part))


def reverse_complement(s: Column | str) -> Column:
    return F.reverse(F.translate(_c(s), *COMPLEMENT))


def nucleotide_index(n: Column | str) -> Column:
    """0 to 3, or null for an ambiguous nucleotide."""
    at = F.position(_c(n), F.lit(NUCLEOTIDES))
    return F.when((F.length(_c(n)) == 1) & (at > 0), at - 1)


def is_ambiguous(s: Column | str) -> Column:
    return ~_c(s).rlike("^[ACGTU]+$")


def is_purine(n: Column | str) -> Column:
    return _c(n).isin("A", "G")


def to_ry(s: Column | str) -> Column:
    """Purines as R, pyrimidines as Y."""
    return F.translate(_c(s), "AGCTU", "RRYYY")


def base4(s: Column | str) -> Column:
    """The index of a motif or codon (two bits a nucleotide), or null if it is ambiguous or empty."""
    clean = F.when(_c(s).rlike("^[ACGT]+$"), F.translate(_c(s), NUCLEOTIDES, "0123"))
    return F.conv(clean, 4, 10).cast("int")


def from_base4(i: Column | str, length: int) -> Column:
    return F.translate(F.lpad(F.conv(_c(i).cast("string"), 10, 4), length, "0"), "0123", NUCLEOTIDES)


def codon_index(codon: Column | str) -> Column:
    """The index of a codon, or null if a nucleotide of it is ambiguous or it isn't 3 long."""
    at = [F.instr(F.lit(NUCLEOTIDES), F.substring(_c(codon), k, 1)) for k in (1, 2, 3)]
    known = (F.length(_c(codon)) == 3) & (at[0] > 0) & (at[1] > 0) & (at[2] > 0)
    return F.when(known, at[0] * 16 + at[1] * 4 + at[2] - 21)


def codon_text(i: Column | str) -> Column:
    """nnn/a, or ---/- for no codon."""
    return F.coalesce(F.concat(from_base4(i, 3), F.lit("/"), residue_of(i)), F.lit("---/-"))


def codon_distance(a: Column, b: Column) -> Column:
    """Number of positions in which two codons, given by index, differ."""
    x = a.bitwiseXOR(b)
    return sum((F.when(F.shiftright(x, k).bitwiseAND(3) != 0, 1).otherwise(0) for k in (0, 2, 4)), F.lit(0))


def residue_of(i: Column | str, code: str | None = None) -> Column:
    """The residue a codon index stands for; `*` is a stop, null for no codon."""
    return F.when(_c(i).isNotNull(), F.substring(F.lit(code or code_by_index()), _c(i) + 1, F.lit(1)))


def is_stop(i: Column | str, code: str | None = None) -> Column:
    return residue_of(i, code) == "*"


def residue(c: Column | str) -> Column:
    """A residue as read: itself if it is one of the known codes, otherwise null (lower case too)."""
    return F.when(F.length(_c(c)) == 1, F.when(F.contains(F.lit(RESIDUES), _c(c)), _c(c)))


def is_regular(c: Column | str) -> Column:
    """Whether a character stands for a residue that takes a codon in the codon walk: known, neither gap nor null."""
    return _c(c).rlike("^[ABCDEFGHIKLMNPQRSTVWXYZ*]$")


def column_code(codons: Column | str) -> Column:
    """A column of codon indices as text: `!` for none, otherwise the character 34 + index."""
    return F.array_join(F.transform(_c(codons), lambda i: F.coalesce(F.char(i + 34), F.lit("!"))), "")


def from_column_code(text: Column | str) -> Column:
    return F.transform(F.split(_c(text), ""), lambda ch: F.when(ch != "!", F.ascii(ch) - 34))


def step(strand: Column | str) -> Column:
    """1 in transcription order from low to high positions, -1 on the reverse strand."""
    return F.when(_c(strand) == REVERSE, -1).otherwise(1)


def along(strand: Column | str, position: Column, k: Column | int) -> Column:
    """The position k steps downstream."""
    return position + step(strand) * k


def splice_sites(strand: Column | str, exon_end: Column, next_start: Column) -> tuple[Column, Column]:
    """(donor, acceptor) of the intron between two exons: first and last intronic base in transcription order."""
    reverse = _c(strand) == REVERSE
    return F.when(reverse, next_start - 1).otherwise(exon_end), F.when(reverse, exon_end).otherwise(next_start - 1)


def alignment_name(path: Column | str) -> Column:
    """The base name of a file up to its first dot."""
    return F.regexp_extract(_c(path), r"([^/.]*)[^/]*$", 1)


def tag(defline: Column | str, name: str) -> Column:
    """The value of /name=value in a defline, bare or in quotes; null if it isn't there. The first one counts."""
    got = F.regexp_extract(_c(defline), rf"/{name}=(?:'([^']*)'|\"([^\"]*)\"|([^\s'\"]\S*))", 0)
    value = F.regexp_replace(F.regexp_replace(got, rf"^/{name}=", ""), "^['\"]|['\"]$", "")
    return F.when(got != "", value)


def ident(defline: Column | str) -> Column:
    """The defline up to its first blank."""
    return F.substring_index(_c(defline), " ", 1)


def cell_text(position: Column, codon: Column, phase: Column) -> Column:
    """One cell of an alignment dump: position, codon and residue, with ^phase where an intron follows."""
    return F.concat(F.coalesce(position.cast("string"), F.lit("-")), F.lit(":"), codon_text(codon), F.when(phase.isNotNull(), F.concat(F.lit("^"), phase.cast("string"))).otherwise(""))
