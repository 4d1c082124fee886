"""Ancestral introns by parsimony on a tree, for one site at a time.

A state is NO_INTRON, MISSING or a placement (2, donor, acceptor, phase); states are ordered in that order, which breaks
what ties the costs leave. The tree is a list of (node, parent) in post-order."""

from __future__ import annotations

from typing import NamedTuple

NO_INTRON, MISSING = (0,), (1,)
State = tuple
#: Shortest intron that may be put where none was annotated.
MIN_INTRON = 24


class Penalties(NamedTuple):
    loss: int = 5
    gain: int = 12
    shift: int = 5
    reannotate: int = 1


def has_intron(state: State) -> bool:
    return state[0] == 2


def edge_cost(parent: State, child: State, p: Penalties, nodes: int) -> int:
    """The cost of a branch. Below MISSING everything else is prohibitive; MISSING below anything is free."""
    if child == MISSING:
        return 0
    if parent == MISSING:
        return nodes * sum(p)
    if child == NO_INTRON:
        return p.loss if has_intron(parent) else 0
    if not has_intron(parent):
        return p.gain
    return p.shift * ((child[1] != parent[1]) + (child[2] != parent[2]))


def label(tree: list[tuple[str, str | None]], leaves: dict[str, dict[State, int]], p: Penalties = Penalties()) -> tuple[dict[str, State], int]:
    """The state of every node, and the total cost. leaves: the costs of each leaf's possible states; a leaf without any is
    MISSING. Of equally good states a child keeps its parent's, else it takes the first in order; so does the root."""
    states = sorted({NO_INTRON, MISSING, *(s for own in leaves.values() for s in own)})
    children: dict[str, list[str]] = {}
    for node, parent in tree:
        if parent is not None:
            children.setdefault(parent, []).append(node)
    below: dict[str, dict[State, int]] = {}
    choice: dict[str, dict[State, State]] = {}
    for node, _ in tree:
        if node not in children:
            below[node] = leaves.get(node) or {MISSING: 0}
            continue
        total = dict.fromkeys(states, 0)
        for child in children[node]:
            choice[child] = {}
            for state in states:
                cost, _, best = min((c + edge_cost(state, s, p, len(tree)), s != state, s) for s, c in below[child].items())
                total[state] += cost
                choice[child][state] = best
        below[node] = total
    out: dict[str, State] = {}
    cost = 0
    for node, parent in reversed(tree):
        if parent is None:
            cost, out[node] = min((c, s) for s, c in below[node].items())
        else:
            out[node] = choice[node][out[parent]]
    return out, cost


def event(state: State, parent: State | None) -> str:
    """What happened on the branch to a node: Gn gain, Ls loss, NO none, na missing; otherwise donor and acceptor event, C
    kept, I or E moved so that intron or exon grew, with the distance."""
    if state == MISSING:
        return "na"
    before = parent is not None and has_intron(parent)
    if state == NO_INTRON:
        return "Ls" if before else "NO"
    if not before:
        return "Gn"
    way = state[2] - state[1]

    def one(moved: int, same: str, other: str, end: str) -> str:
        return f"C{end}" if not moved else f"{same if moved * way > 0 else other}{end}({abs(moved)})"

    donor, acceptor = one(state[1] - parent[1], "E", "I", "5"), one(state[2] - parent[2], "I", "E", "3")
    return f"{donor},{acceptor}"
