"""Problem 7: filling containers of fixed capacity.

Method: swap-based local search. Items are spread evenly over groups of a set size; in each they are laid into containers as
they come (next fit, which leaves about a quarter of the space unused). Then items are moved or exchanged one for one and
two for one between underfull containers wherever that increases the sum of squared fills, so that full containers fill up
and others run empty, until no such exchange is left or no fewer containers could hold the group's items. Rounds over the nearest candidates go first; a search of all exchanges decides that none is left."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exonia.llm.sizes import token_sizes

#: Items packed in one task; with more of them the part of a container that a group leaves unused matters less.
GROUP_ITEMS = 16_384
#: What a quick round looks at: pairs of the largest items of a container, and the nearest units for each unit. They set how
#: fast the search is, not where it ends.
PAIRED, NEAREST = 24, 6


def next_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """A container for each item (0 < size <= capacity), in order: the current one, or a new one where that is too full."""
    box = np.empty(len(sizes), np.int64)
    n = fill = 0
    for i, size in enumerate(sizes.tolist()):
        if fill + size > capacity:
            n, fill = n + 1, 0
        fill += size
        box[i] = n
    return box


def improve(sizes: np.ndarray, box: np.ndarray, capacity: int) -> np.ndarray:
    """The local search; returns the items' containers. Every exchange increases the sum of squared fills, so it ends."""
    box = box.copy()
    least = -(-int(sizes.sum()) // capacity)
    while True:
        fill = np.bincount(box, sizes, minlength=int(box.max()) + 1).astype(np.int64)
        if np.count_nonzero(fill) <= least:
            break
        if not _round(sizes, box, fill, capacity) and not _whole_round(sizes, box, fill, capacity):
            break
    return box


def _round(sizes: np.ndarray, box: np.ndarray, fill: np.ndarray, capacity: int) -> int:
    """The best exchanges among the nearest candidates, each container in one of them at most; changes box."""
    at = np.flatnonzero(fill[box] < capacity)
    at = at[np.lexsort((-sizes[at], box[at]))]
    owner, size = box[at], sizes[at]
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    nth = np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))
    # What can change places: nothing, one item, or two items of one container.
    bins = owner[first]
    unit = [np.column_stack([bins, 0 * bins, 0 * bins - 1, 0 * bins - 1]), np.column_stack([owner, size, at, 0 * at - 1])]
    for step in range(1, PAIRED):
        a = np.flatnonzero((nth[step:] >= step) & (nth[step:] < PAIRED))
        if not len(a):
            break
        unit.append(np.column_stack([owner[a], size[a] + size[a + step], at[a], at[a + step]]))
    units = np.concatenate(unit)
    units = units[np.argsort(units[:, 1], kind="stable")]
    own, total = units[:, 0], units[:, 1]
    # For each unit the largest one elsewhere that fits in its place, if that makes the sum of squares larger.
    k = np.searchsorted(total, total + (capacity - fill[own]), "right") - 1
    best, gain = np.full(len(units), -1), np.zeros(len(units), np.int64)
    for _ in range(NEAREST):
        other = own[k]
        more = total[k] - total
        g = np.where((other != own) & (more > 0), 2 * more * (fill[own] - fill[other] + more), 0)
        better = g > gain
        best[better], gain[better] = k[better], g[better]
        k = np.maximum(k - 1, 0)
    return _exchange(box, units, best, gain)


def _whole_round(sizes: np.ndarray, box: np.ndarray, fill: np.ndarray, capacity: int) -> int:
    """As _round, with every exchange considered: 0 only if none is left.

    Units of one container and total are the same to an exchange, so one stands for all; a container of d sizes has at most
    d * d / 2 + 2 * d + 1 of them, and no more than its fill + 1. Of the units of one total the one in the emptiest container
    gains most, and the next one serves that container itself."""
    at = np.flatnonzero(fill[box] < capacity)
    at = at[np.lexsort((-sizes[at], box[at]))]
    owner, size = box[at], sizes[at]
    if not len(at) or owner[0] == owner[-1]:
        return 0
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    bins = owner[first]
    kept = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(size, prepend=-1) != 0))
    twice = kept[np.diff(kept, append=len(at)) > 1]
    unit = [
        np.column_stack([bins, 0 * bins, 0 * bins - 1, 0 * bins - 1]),
        np.column_stack([owner[kept], size[kept], at[kept], 0 * kept - 1]),
        np.column_stack([owner[twice], 2 * size[twice], at[twice], at[twice + 1]]),
    ]
    step = 1
    while len(a := np.flatnonzero(owner[kept[step:]] == owner[kept[: len(kept) - step]])):
        a, b = kept[a], kept[a + step]
        unit.append(np.column_stack([owner[a], size[a] + size[b], at[a], at[b]]))
        step += 1
    units = np.concatenate(unit)
    units = units[np.lexsort((units[:, 0], fill[units[:, 0]], units[:, 1]))]
    units = units[(np.diff(units[:, 0], prepend=-1) != 0) | (np.diff(units[:, 1], prepend=-1) != 0)]
    own, total = units[:, 0], units[:, 1]
    start = np.flatnonzero(np.diff(total, prepend=-1))
    second = np.where(np.diff(start, append=len(total)) > 1, start + 1, start)
    totals = total[start]
    low, lower = np.sort(fill[bins])[:2]
    emptiest = np.where(fill[own] == low, lower, low)
    best, gain = np.full(len(units), -1), np.zeros(len(units), np.int64)
    k = np.searchsorted(totals, total + (capacity - fill[own]), "right") - 1
    u = np.arange(len(units))
    while len(u):
        more = totals[k] - total[u]
        # No smaller unit gains more than this one would against the emptiest container.
        on = (more > 0) & (2 * more * (fill[own[u]] - emptiest[u] + more) > gain[u])
        u, k, more = u[on], k[on], more[on]
        v = np.where(own[start[k]] == own[u], second[k], start[k])
        g = np.where(own[v] != own[u], 2 * more * (fill[own[u]] - fill[own[v]] + more), 0)
        better = g > gain[u]
        best[u[better]], gain[u[better]] = v[better], g[better]
        k = k - 1
    return _exchange(box, units, best, gain)


def _exchange(box: np.ndarray, units: np.ndarray, best: np.ndarray, gain: np.ndarray) -> int:
    """Carries out the exchanges of units u and best[u] that gain most, each container in one at most; changes box."""
    own = units[:, 0]
    used: set[int] = set()
    done = 0
    for u in np.argsort(-gain, kind="stable"):
        if gain[u] <= 0:
            break
        v = best[u]
        a, b = int(own[u]), int(own[v])
        if a in used or b in used:
            continue
        used |= {a, b}
        done += 1
        for i in units[v, 2:]:
            if i >= 0:
                box[i] = a
        for i in units[u, 2:]:
            if i >= 0:
                box[i] = b
    return done


def pack(sizes: np.ndarray, capacity: int) -> pd.DataFrame:
    """(item, part, tok_start, n_tokens, box) for items of any size from 0: one above the capacity gives full parts and the
    rest, others come whole. Items of size 0 lie in the first container."""
    full = np.where(sizes > capacity, (sizes - 1) // capacity, 0)
    rest = sizes - full * capacity
    box = np.zeros(len(sizes), np.int64)
    real = np.flatnonzero(rest > 0)
    if len(real):
        box[real] = improve(rest[real], next_fit(rest[real], capacity), capacity)
    item = np.repeat(np.arange(len(sizes)), full)
    part = np.arange(len(item)) - np.repeat(np.cumsum(full) - full, full)
    parts = [
        pd.DataFrame({"item": np.arange(len(sizes)), "part": full, "tok_start": full * capacity, "n_tokens": rest, "box": box}),
        pd.DataFrame({"item": item, "part": part, "tok_start": part * capacity, "n_tokens": capacity, "box": box.max(initial=0) + 1 + np.arange(len(item))}),
    ]
    out = pd.concat(parts, ignore_index=True)
    out["box"] = np.unique(out["box"], return_inverse=True)[1]
    return out


def containers(docs: DataFrame, limits: list[tuple[int, str, int]], doc_id: str = "doc_id", text: str = "text", group_items: int = GROUP_ITEMS) -> DataFrame:
    """(limit_id, doc_id, part, tok_start, n_tokens, container) for each limit (limit_id, tokenizer, capacity).

    Every row of docs comes out for every limit: whole, or in parts if its text has more tokens than the capacity, all
    but the last of which are full. Null and empty texts have size 0 and lie in some container. Repeated rows are items
    of their own. A container's tokens never exceed the capacity; its number is unique within the limit."""
    if not limits:
        raise ValueError("no limits")
    if min(c for _, _, c in limits) < 1:
        raise ValueError("a capacity below 1")
    groups = max(1, -(-docs.count() // group_items))
    key = docs.schema[doc_id].dataType.simpleString()
    out = None
    for tokenizer in sorted({t for _, t, _ in limits}):
        own = [(i, c) for i, t, c in limits if t == tokenizer]
        sizes = token_sizes(docs.withColumn("_row", F.monotonically_increasing_id()), ["_row", doc_id], text, tokenizer)
        kinds = F.array(*(F.struct(F.lit(i).alias("limit_id"), F.lit(c).alias("capacity")) for i, c in own))
        spread = sizes.select(F.pmod(F.xxhash64("_row"), F.lit(groups)).cast("int").alias("_group"), "_row", F.col(doc_id).alias("doc_id"), "n_tokens", F.inline(kinds))

        def fill(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_row", ignore_index=True)
            got = pack(pdf["n_tokens"].to_numpy(np.int64), int(pdf["capacity"].iloc[0]))
            at = got.pop("item").to_numpy()
            got.insert(0, "limit_id", pdf["limit_id"].iloc[0])
            got.insert(1, "doc_id", pdf["doc_id"].array.take(at))
            got["container"] = (int(pdf["_group"].iloc[0]) << 32) + got.pop("box")
            return got

        packed = spread.groupBy("limit_id", "capacity", "_group").applyInPandas(fill, f"limit_id int, doc_id {key}, part int, tok_start int, n_tokens int, container bigint")
        out = packed if out is None else out.unionByName(packed)
    return out.withColumnRenamed("doc_id", doc_id)
