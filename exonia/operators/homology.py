"""Homologous splice sites of one alignment: brackets around introns, contexts, consistent components and candidate sites,
then ancestral states and the edits that follow from them.

An alignment is small (a sequence an organism), alignments are many: each is one group, and the work within it is order
dependent, so it is done by a grouped function. Scores and the tree are bounded by the number of organisms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exonia.operators import parsimony
from exonia.operators.scoring import NEVER, generic_scores
from exonia.session import stored

#: An anchor must score more than so many times the expected score of a codon pair.
ANCHOR = 4
COMPLEMENT = str.maketrans("ACGTRYKMBVDH", "TGCAYRMKVBHD")
BASES = {"A": 0, "G": 1, "C": 2, "T": 3}
#: The generic scores of the dinucleotides of donors and acceptors.
GENERIC = {kind: generic_scores(kind) for kind in ("donor", "acceptor")}
CODON_INDEX = {a + b + c: 16 * BASES[a] + 4 * BASES[b] + BASES[c] for a in BASES for b in BASES for c in BASES}


@dataclass
class Member:
    """A sequence of the alignment: its gene on a piece of contig that begins at `origin`, and what each column holds."""

    organism: str
    strand: str
    exons: list[tuple[int, int]]
    dna: str
    origin: int
    position: list[int | None]  # of the first base of each column's codon; None: gap
    codon: list[int | None]
    phase: list[int]  # of an intron in the column's codon, 1 to 3; 0: none

    @property
    def step(self) -> int:
        return -1 if self.strand == "-" else 1

    def read(self, position: int, n: int) -> str | None:
        """n bases downstream from a position; None where the contig piece doesn't hold them."""
        lo = position - self.origin - (n - 1 if self.step < 0 else 0)
        if lo < 0 or lo + n > len(self.dna):
            return None
        text = self.dna[lo : lo + n]
        return text if self.step > 0 else text.translate(COMPLEMENT)[::-1]

    def motif(self, position: int, donor: bool) -> str | None:
        """The dinucleotide at a donor (from its first base) or an acceptor (up to its last)."""
        return self.read(position if donor else position - self.step, 2)

    def between(self, a: int, b: int) -> int:
        """Bases from a downstream to b."""
        return (b - a) * self.step


def walk(residues: str, exons: list[tuple[int, int]], strand: str, dna: str, origin: int, organism: str) -> Member:
    """Puts a gene's codons and introns into the columns of its aligned protein: every residue takes the next 3 bases."""
    order = exons if strand != "-" else exons[::-1]
    me = Member(organism, strand, exons, dna, origin, [], [], [])
    bases = "".join(me.read(s if strand != "-" else e - 1, e - s) or "N" * (e - s) for s, e in order if e > s)
    ends = np.cumsum([e - s for s, e in order])
    last_base = {int(n) - 1 for n in ends[:-1] if n > 0}
    codons = sum(c != "-" for c in residues)
    # The exon that holds each codon's first base, and so that base's position.
    first = 3 * np.arange(codons)
    exon = np.searchsorted(ends, first, "right")
    inside = exon < len(order)
    exon = np.minimum(exon, len(order) - 1)
    into = first - np.append(0, ends[:-1])[exon]
    low, high = np.array(order, dtype=np.int64).T
    places = np.where(strand == "-", high[exon] - 1 - into, low[exon] + into)
    k = 0
    for c in residues:
        if c == "-":
            me.position.append(None), me.codon.append(None), me.phase.append(0)
            continue
        me.position.append(int(places[k]) if inside[k] else None)
        me.codon.append(CODON_INDEX.get(bases[3 * k : 3 * k + 3]))
        me.phase.append(next((j + 1 for j in range(3) if 3 * k + j in last_base), 0))
        k += 1
    return me


class Scores:
    """Substitution scores and their expectation for pairs of organisms, and middle-codon scores, as arrays."""

    def __init__(self, organisms: list[str], substitution: np.ndarray, expected: np.ndarray, middle: np.ndarray):
        self.index = {o: i for i, o in enumerate(organisms)}
        self.substitution, self.expected, self.middle = substitution.astype(np.int32), expected, middle

    def limit(self, a: str, b: str) -> int:
        return int(ANCHOR * self.expected[self.index[a], self.index[b]])

    def pair(self, a: str, b: str) -> np.ndarray:
        return self.substitution[self.index[a], self.index[b]]


@dataclass
class Bracket:
    left: int = -1
    left_score: int = 0
    right: int = -1
    right_score: int = 0

    @property
    def valid(self) -> bool:
        return self.left_score > 0 and self.right_score > 0


@dataclass
class Context:
    first: int
    last: int
    pairs: dict[tuple[int, int], Bracket] = field(default_factory=dict)

    def widen(self) -> None:
        for b in self.pairs.values():
            if b.valid:
                self.first, self.last = min(self.first, b.left), max(self.last, b.right)


def bracket(q: Member, r: Member, column: int, scores: Scores) -> Bracket:
    """The nearest well-conserved segments to the left and right of q's intron in a column."""
    table, limit = scores.pair(q.organism, r.organism), scores.limit(q.organism, r.organism)

    def gain(c: int, barred: bool) -> int | None:
        """The column's score; None where both have gaps, NEVER where the segment breaks."""
        gaps = (q.position[c] is None) + (r.position[c] is None)
        if gaps:
            return None if gaps == 2 else NEVER
        if barred:
            return NEVER
        x, y = q.codon[c], r.codon[c]
        return int(table[x, y]) if x is not None and y is not None else 0

    def close(best: int) -> int:
        return 0 if best < limit else best

    out = Bracket()
    edge = column + (q.phase[column] == 3)
    score = best = 0
    for c in range(edge - 1, -1, -1):
        # An intron behind the codon may only end the segment.
        free = {0, 3} if edge == c + 1 else {0}
        g = gain(c, q.phase[c] not in free or r.phase[c] not in free)
        score = score if g is None else 0 if g == NEVER else score + g
        if score <= 0:
            edge, score = c, 0
        elif score > best:
            best, out.left = score, edge
            if best > limit:
                break
    out.left_score = close(best)
    edge = column + 1
    score = best = 0
    for c in range(edge, len(q.position)):
        g = gain(c, q.phase[c] in (1, 2) or r.phase[c] in (1, 2))
        score = score if g is None else 0 if g == NEVER else score + g
        if score > best:
            best, out.right = score, edge
            if best > limit:
                break
        both = q.position[c] is not None and r.position[c] is not None
        if score <= 0 or (both and 3 in (q.phase[c], r.phase[c])):
            edge, score = c + 1, 0
    out.right_score = close(best)
    return out


def contexts(members: list[Member], scores: Scores) -> list[Context]:
    """Contexts of the intron columns in order; those that overlap are fused. The left bracket of a fused pair is that of
    the earlier context, the right one that of the later, and only fused brackets widen it."""
    out: list[Context] = []
    width = min(len(m.position) for m in members)
    for column in range(width):
        queries = [i for i, m in enumerate(members) if m.phase[column]]
        if not queries:
            continue
        now = Context(column, column, {(q, r): bracket(members[q], members[r], column, scores) for q in queries for r in range(len(members)) if r != q})
        now.widen()
        while out and out[-1].last >= now.first:
            before = out.pop()
            for key, b in now.pairs.items():
                a = before.pairs.get(key)
                before.pairs[key] = b if a is None else Bracket(a.left, a.left_score, b.right, b.right_score)
            before.widen()
            now = before
        out.append(now)
    return out


def segments(m: Member, b: Bracket) -> list[int]:
    """Coding lengths between the brackets, cut at introns."""
    out = [0] if b.left > 0 and m.phase[b.left - 1] == 3 else []
    n = 0
    for c in range(b.left, b.right):
        if m.phase[c]:
            out.append(n + m.phase[c])
            n = 3 - m.phase[c]
        elif m.position[c] is not None:
            n += 3
    return [*out, n]


def region(m: Member, b: Bracket) -> tuple[int, int] | None:
    """Genomic start and end (exclusive, downstream) of the bracketed region; None where a bracket lies at a gap."""
    if b.left < 1 or b.right >= len(m.position):
        return None
    start, end = m.position[b.left - 1], m.position[b.right]
    return None if start is None or end is None else (start + 3 * m.step, end)


def intron_count(m: Member, ctx: Context) -> int:
    return (ctx.first > 0 and m.phase[ctx.first - 1] == 3) + sum(m.phase[c] > 0 for c in range(ctx.first, ctx.last))


class Diagonals:
    """Positions of several strands along one origin: by an offset on equal strands, by a sum on opposite ones."""

    def __init__(self, members: list[Member], origin: int):
        self.members, self.origin, self.offset = members, origin, {origin: 0}

    def absolute(self, k: int, position: int) -> int:
        same = self.members[k].strand == self.members[self.origin].strand
        return position - self.offset[k] if same else self.offset[k] - position

    def local(self, k: int, position: int) -> int:
        same = self.members[k].strand == self.members[self.origin].strand
        return position + self.offset[k] if same else self.offset[k] - position

    def match(self, a: int, x: int, b: int, y: int) -> bool:
        """Notes that x in a (known) is y in b; False if something else was known."""
        at = self.absolute(a, x)
        if b in self.offset:
            return self.local(b, at) == y
        same = self.members[b].strand == self.members[self.origin].strand
        self.offset[b] = y - at if same else y + at
        return True


@dataclass
class Sites:
    """Candidate sites of each member in absolute coordinates: (kind, position) to [annotated, phase]; kinds are donor,
    acceptor and none. A site found with several phases keeps the smallest."""

    donors: Diagonals
    acceptors: Diagonals
    known: dict[int, dict[tuple[str, int], list]] = field(default_factory=dict)

    def add(self, k: int, kind: str, position: int, phase: int, annotated: bool) -> None:
        at = position if kind == "none" else (self.donors if kind == "donor" else self.acceptors).absolute(k, position)
        entry = self.known.setdefault(k, {}).setdefault((kind, at), [False, phase])
        entry[0] |= annotated
        entry[1] = min(entry[1], phase)


def components(members: list[Member], ctx: Context) -> list[tuple[Diagonals, Diagonals, bool]]:
    """Depth-first from each sequence with an intron, in order, along valid brackets; the flag tells whether all matches
    agree. A bracket that lies at a gap of either sequence matches nothing and disagrees."""
    owner: dict[int, tuple[Diagonals, Diagonals]] = {}
    out = []
    for seed, m in enumerate(members):
        if seed in owner or not intron_count(m, ctx):
            continue
        both = owner[seed] = (Diagonals(members, seed), Diagonals(members, seed))
        agrees, stack = True, [(seed, iter(range(len(members))))]
        while stack:
            q, refs = stack[-1]
            r = next(refs, None)
            if r is None:
                stack.pop()
                continue
            b = ctx.pairs.get((q, r))
            if b is None or not b.valid:
                continue
            x, y = region(members[q], b), region(members[r], b)
            if x is None or y is None:
                agrees = False
                continue
            agrees &= both[0].match(q, x[0], r, y[0])
            agrees &= both[1].match(q, x[1], r, y[1])
            if r not in owner:
                owner[r] = both
                stack.append((r, iter(range(len(members)))))
        out.append((*both, agrees))
    return out


def collected(members: list[Member], ctx: Context, scores: Scores) -> Sites | None:
    """The candidate sites of a context, if it has one consistent component, no sequence with two introns, and the component
    spans more than half of the sequences."""
    found = [c for c in components(members, ctx) if c[2]]
    if len(found) != 1 or max(intron_count(m, ctx) for m in members) != 1 or len(found[0][0].offset) <= len(members) // 2:
        return None
    sites = Sites(found[0][0], found[0][1])
    inside = sorted(sites.donors.offset)
    for q in inside:
        sites.known.setdefault(q, {})
        for r in inside:
            b = ctx.pairs.get((q, r))
            if b is not None and b.valid:
                propose(sites, members, q, r, b, scores)
    return sites


def in_frame(n: int) -> int:
    return n % 3 or 3


def propose(sites: Sites, members: list[Member], q: int, r: int, b: Bracket, scores: Scores) -> None:
    """Annotated sites of both sequences, and what q's intron suggests: none in q, or one at the same place in r."""
    own = {k: (members[k], segments(members[k], b), region(members[k], b)) for k in (q, r)}
    for k in (r, q):
        m, parts, (start, end) = own[k]
        if len(parts) == 1:
            sites.add(k, "none", 0, 0, True)
        else:
            sites.add(k, "donor", start + m.step * parts[0], in_frame(parts[0]), True)
            sites.add(k, "acceptor", end - m.step * (parts[-1] + 1), in_frame(parts[0]), True)
    (query, parts, (q_start, q_end)), (ref, ref_parts, (r_start, r_end)) = own[q], own[r]
    q_len, r_len = query.between(q_start, q_end), ref.between(r_start, r_end)
    donor, acceptor = parts[0], parts[-1]
    alone = len(ref_parts) == 1
    if len(parts) == 2 and alone and q_len % 3 == 0 and reads_through(query, q_start + query.step * 3 * (donor // 3), q_end - query.step * 3 * (acceptor // 3), scores):
        coding = donor + acceptor
        if r_len - coding > int((q_len - coding) / 3):
            sites.add(q, "none", 0, 0, False)
    for kind, offset, other, at, phase in (
        ("donor", donor, ref_parts[0], r_start + ref.step * donor, in_frame(donor)),
        ("acceptor", acceptor, ref_parts[-1], r_end - ref.step * (acceptor + 1), 3 - acceptor % 3),
    ):
        wanted = alone or (other != offset and offset < r_len)
        if wanted and r_len >= 2 + offset and GENERIC[kind].get(ref.motif(at, kind == "donor") or "", NEVER) != NEVER:
            sites.add(r, kind, at, phase, False)


def reads_through(m: Member, start: int, end: int, scores: Scores) -> bool:
    """Whether the triplets from start to end could all be codons within a gene; ambiguous ones are passed over."""
    middle = scores.middle[scores.index[m.organism]]
    for k in range(m.between(start, end) // 3):
        index = [BASES.get(b) for b in m.read(start + m.step * 3 * k, 3) or "NNN"]
        if None not in index and middle[16 * index[0] + 4 * index[1] + index[2]] == NEVER:
            return False
    return True


def leaf_states(sites: Sites, members: list[Member], p: parsimony.Penalties) -> dict[str, dict[parsimony.State, int]]:
    """The possible states of each member of the component and what they cost."""
    out = {}
    for k, known in sites.known.items():
        m, states = members[k], {}
        for (kind, at), (annotated, phase) in known.items():
            if kind == "none":
                states[parsimony.NO_INTRON] = 0 if annotated else p.reannotate
            if kind != "donor":
                continue
            for (other, end), (annotated_end, phase_end) in known.items():
                if other == "acceptor" and phase_end == phase:
                    length = m.between(sites.donors.local(k, at), sites.acceptors.local(k, end)) + 1
                    if (annotated and annotated_end) or length >= parsimony.MIN_INTRON:
                        states[(2, at, end, phase)] = p.reannotate * ((not annotated) + (not annotated_end))
        out[m.organism] = states
    return out


def annotation(known: dict[tuple[str, int], list]) -> parsimony.State | None:
    """The annotated state of a member: no intron, a placement, or None."""
    if known.get(("none", 0), [False])[0]:
        return parsimony.NO_INTRON
    best = {kind: min(((at, e[1]) for (k, at), e in known.items() if k == kind and e[0]), default=None) for kind in ("donor", "acceptor")}
    return None if None in best.values() else (2, best["donor"][0], best["acceptor"][0], best["donor"][1])


def edits(sites: Sites, members: list[Member], labels: dict[str, parsimony.State]) -> Iterator[tuple[str, str, int | None, int | None, int | None]]:
    """(organism, edit, donor, acceptor, shift) that bring each member's gene to its inferred state, in its coordinates."""
    for k in sorted(sites.known):
        m, state, now = members[k], labels.get(members[k].organism), annotation(sites.known[k])
        if state is None:
            continue
        local = lambda s, k=k: (sites.donors.local(k, s[1]), sites.acceptors.local(k, s[2]))
        if not parsimony.has_intron(state):
            if now is not None and parsimony.has_intron(now):
                yield m.organism, "exonify", *local(now), None
        elif now is None or not parsimony.has_intron(now):
            yield m.organism, "intronify", *local(state), None
        else:
            (d, a), (d0, a0) = local(state), local(now)
            if d != d0:
                yield m.organism, "donor", d, None, m.between(d0, d)
            if a != a0:
                yield m.organism, "acceptor", None, a, m.between(a0, a)


def edited(exons: list[tuple[int, int]], strand: str, edit: str, donor: int | None, acceptor: int | None) -> list[tuple[int, int]]:
    """Exons after one edit."""
    reverse = strand == "-"
    if edit in ("donor", "acceptor"):
        at = donor if edit == "donor" else acceptor
        if reverse == (edit == "donor"):
            i = next(i for i, e in enumerate(exons) if e[1] > at)
            return [*exons[:i], (at + 1, exons[i][1]), *exons[i + 1 :]]
        i = next(i for i in range(len(exons) - 1, -1, -1) if exons[i][0] <= at)
        return [*exons[:i], (exons[i][0], at), *exons[i + 1 :]]
    below, above = (acceptor, donor + 1) if reverse else (donor, acceptor + 1)
    left = next(e for e in exons if e[1] >= below)
    right = next(e for e in exons if e[1] >= above)
    middle = [(left[0], right[1])] if edit == "exonify" else [(left[0], below), (above, right[1])]
    return [e for e in exons if e[1] < below] + middle + [e for e in exons if e[0] > above]


def two_introns_in_a_codon(members: list[Member]) -> bool:
    """Whether a gene has two introns in one codon; such an alignment isn't judged."""
    for m in members:
        order = m.exons if m.strand != "-" else m.exons[::-1]
        codons = [(int(n) - 1) // 3 for n in np.cumsum([e - s for s, e in order])[:-1] if n > 0]
        if len(set(codons)) < len(codons):
            return True
    return False


def _members(table: pa.Table) -> list[Member]:
    rows = sorted(table.to_pylist(), key=lambda r: r["organism"])
    return [walk(r["residues"], [(e["start"], e["end"]) for e in r["exons"]], r["strand"], r["dna"], r["origin"], r["organism"]) for r in rows]


PARTS = {
    "contexts": "alignment string, ctx int, first_col int, last_col int, valid_pairs int, usable boolean",
    "nodes": "alignment string, ctx int, node_no int, node string, parent string, is_leaf boolean, state string, donor int, acceptor int, phase int, event string, cost int, own_donor int, own_acceptor int, motifs string, donor_shift int, acceptor_shift int",
    "edits": "alignment string, ctx int, organism string, edit string, donor int, acceptor int, shift int, exon_starts string, exon_ends string",
}
FIELDS = {name: kind for part in PARTS.values() for name, kind in (f.split(" ") for f in part.split(", "))}
#: Sequences that one task takes: their work is heavy for its bytes.
SEQUENCES_PER_TASK = 256


def doubled(sequences: DataFrame, organisms: list[str]) -> DataFrame:
    """(alignment, organism, n): organisms with several sequences in an alignment, which isn't judged for that."""
    return sequences.where(F.col("organism").isin(organisms)).groupBy("alignment", "organism").agg(F.count("*").alias("n")).where("n > 1")


def leaf_details(sites: Sites, members: list[Member], k: int, state: parsimony.State) -> dict:
    """A leaf's intron in its organism's coordinates, its dinucleotides (`..` beyond the contig piece) and how far its sites lie from
    the annotated ones (null where no intron is annotated)."""
    m, now = members[k], annotation(sites.known[k])
    d, a = sites.donors.local(k, state[1]), sites.acceptors.local(k, state[2])
    out = {"own_donor": d, "own_acceptor": a, "motifs": f"{m.motif(d, True) or '..'}-{m.motif(a, False) or '..'}"}
    if now is not None and parsimony.has_intron(now):
        out |= {"donor_shift": m.between(sites.donors.local(k, now[1]), d), "acceptor_shift": m.between(sites.acceptors.local(k, now[2]), a)}
    return out


def history(members: list[Member], scores: Scores, tree: list[tuple[str, str | None]], p: parsimony.Penalties) -> Iterator[dict]:
    """The contexts of an alignment, and for each usable one its nodes and the edits of its genes, as rows of PARTS."""
    inner = {parent for _, parent in tree}
    place = {m.organism: k for k, m in enumerate(members)}
    genes = {m.organism: m.exons for m in members}
    for n, ctx in enumerate(contexts(members, scores)):
        sites = collected(members, ctx, scores)
        yield {"kind": "contexts", "ctx": n, "first_col": ctx.first, "last_col": ctx.last, "valid_pairs": sum(b.valid for b in ctx.pairs.values()), "usable": sites is not None}
        if sites is None:
            continue
        labels, cost = parsimony.label(tree, leaf_states(sites, members, p), p)
        for k, (node, parent) in enumerate(tree):
            s = labels[node]
            row = {"kind": "nodes", "ctx": n, "node_no": k, "node": node, "parent": parent, "is_leaf": node not in inner, "state": ("none", "missing", "intron")[s[0]]}
            if parsimony.has_intron(s):
                row |= dict(zip(("donor", "acceptor", "phase"), s[1:], strict=True))
                if node in place and place[node] in sites.known:
                    row |= leaf_details(sites, members, place[node], s)
            yield row | {"event": parsimony.event(s, s if parent is None else labels[parent]), "cost": cost}
        for organism, edit, donor, acceptor, shift in edits(sites, members, labels):
            genes[organism] = edited(genes[organism], members[place[organism]].strand, edit, donor, acceptor)
            starts, ends = (",".join(str(e[i]) for e in genes[organism]) for i in (0, 1))
            yield {"kind": "edits", "ctx": n, "organism": organism, "edit": edit, "donor": donor, "acceptor": acceptor, "shift": shift, "exon_starts": starts, "exon_ends": ends}


def reconstructed(sequences: DataFrame, scores: Scores, tree: list[tuple[str, str | None]], penalties: parsimony.Penalties = parsimony.Penalties()) -> DataFrame:
    """Contexts, node states and edits of every alignment in one pass: `kind` tells which of PARTS a row is of; see part().

    sequences: (alignment, organism, strand, exons, residues, dna, origin); organisms without scores are left out before they
    are grouped. Alignments of one sequence, those with two introns of a gene in one codon, and those with several sequences
    of one organism, of which none is the right one (see doubled), give nothing. Scores and tree, which are bounded by the
    organisms, are broadcast."""
    spark = sequences.sparkSession
    row = F.struct("strand", "exons", "residues", "dna", "origin")
    known = sequences.where(F.col("organism").isin(list(scores.index)))
    once = stored(known.groupBy("alignment", "organism").agg(F.min(row).alias("_r"), F.count("*").alias("_n")).select("alignment", "organism", "_r.*", "_n"), "sequences")
    sent = spark.sparkContext.broadcast((scores, tree, penalties))

    kinds = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([("kind", pa.string()), *((name, kinds[kind]) for name, kind in FIELDS.items())])

    def work(table: pa.Table) -> pa.Table:
        members = _members(table) if set(table["_n"].to_pylist()) == {1} else []
        judged = len(members) > 1 and not two_introns_in_a_codon(members)
        name = {"alignment": table["alignment"][0].as_py()}
        return pa.Table.from_pylist([row | name for row in history(members, *sent.value)] if judged else [], schema)

    tasks = max(1, -(-once.count() // SEQUENCES_PER_TASK))
    return once.repartition(tasks, "alignment").groupBy("alignment").applyInArrow(work, ", ".join(["kind string", *(f"{n} {k}" for n, k in FIELDS.items())]))


def part(rows: DataFrame, kind: str) -> DataFrame:
    """The rows of one kind, with its columns."""
    return rows.where(F.col("kind") == kind).select(*(f.split(" ")[0] for f in PARTS[kind].split(", ")))
