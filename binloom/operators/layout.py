"""Planning of a filter tree: which user bins share, fill or split which technical bins.

Planning works on counts and sketches, one small record per user bin, on the
driver; the data itself never leaves the executors. The search over technical
bins is vectorised in NumPy.

A *path* is the sequence of technical bins that lead from the top filter to the
filter that stores a user bin; the top filter has the empty path.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np

from binloom.config import FilterConfig
from binloom.functions import sizing
from binloom.operators.sketch import np_estimate

_INFINITE = 2**64 - 1


@dataclass
class Layout:
    """``placed``: (path, storage_tb, n_tbs, user_bin); ``merged``: (path, fullest bin) of each lower filter."""

    top_max_bin: int = 0
    merged: list[tuple[tuple[int, ...], int]] = field(default_factory=list)
    placed: list[tuple[tuple[int, ...], int, int, int]] = field(default_factory=list)

    def clear(self) -> None:
        self.top_max_bin, self.merged, self.placed = 0, [], []


@dataclass
class Workspace:
    """What planning knows: counts and sketches by user bin, and the order in which bins are laid out."""

    counts: np.ndarray
    positions: list[int]
    fpr_correction: np.ndarray
    relaxed_correction: float
    sketches: np.ndarray | None = None

    def validate(self) -> None:
        if self.counts is None:
            raise ValueError("counts must be given")
        if self.sketches is not None and len(self.sketches) != len(self.counts):
            raise ValueError("counts and sketches must have the same size")
        if len(self.positions) > len(self.counts):
            raise ValueError("there must not be more positions than counts")
        if len(self.fpr_correction) == 0:
            raise ValueError("fpr_correction must not be empty")
        if not 0.0 < self.relaxed_correction <= 1.0:
            raise ValueError("relaxed_correction must be in (0.0,1.0]")


def sort_by_cardinality(counts: np.ndarray, positions: list[int]) -> list[int]:
    """Largest first; ties keep their order, at the top that of their ids."""
    return sorted(positions, key=lambda p: -int(counts[p]))


def union_estimates(sketches: np.ndarray, counts: np.ndarray, positions: list[int], last: int) -> np.ndarray:
    """For each place up to ``last``, the estimated union of the bins from there to ``last``."""
    rows = sketches[[positions[i] for i in range(last, -1, -1)]]
    grown = np.maximum.accumulate(rows, axis=0)
    out = np.array([int(np_estimate(g)) for g in grown[::-1]], np.int64)
    out[last] = counts[positions[last]]
    return out


def prefix_estimates(sketches: np.ndarray, counts: np.ndarray, positions: list[int]) -> np.ndarray:
    """For each place, the estimated union of the bins up to it."""
    grown = np.maximum.accumulate(sketches[positions], axis=0)
    out = np.array([int(np_estimate(g)) for g in grown], np.int64)
    out[0] = counts[positions[0]]
    return out


def size_intervals(counts: np.ndarray, positions: list[int], ratio: float) -> list[tuple[int, int]]:
    """Stretches of the order in which no bin is smaller than ``ratio`` times the first."""
    cuts, first = [], 0
    for last in range(1, len(positions) + 1):
        if last == len(positions) or counts[positions[first]] * ratio > counts[positions[last]]:
            cuts.append((first, last))
            first = last
    return cuts


def rearrange(sketches: np.ndarray, counts: np.ndarray, positions: list[int], ratio: float) -> list[int]:
    """The order with similar bins next to each other, within bins of like size.

    Each interval is clustered bottom up by estimated Jaccard distance; ties go
    to the smaller ids. The last bin of the interval before takes part, so that
    the interval begins next to what is most like it.
    """
    out: list[int] = []
    for first, last in size_intervals(counts, positions, ratio):
        own = positions[first:last]
        out += _clustered([sketches[p] for p in own], own, (sketches[out[-1]], out[-1]) if out else None)
    return out


def _clustered(lines: list[np.ndarray], labels: list[int], before: tuple | None) -> list[int]:
    lines = list(lines)
    leaves: list = list(labels)
    if before is not None:
        lines.append(before[0])
        leaves.append(None)  # marks the bin that only lends its place
    trees: list = [[x] for x in leaves]
    holds = [x is None for x in leaves]
    estimates = [np_estimate(x) for x in lines]

    def distance(i: int, j: int) -> float:
        return 2 - (estimates[i] + estimates[j]) / np_estimate(np.maximum(lines[i], lines[j]))

    queue = [(distance(i, j), i, j) for i in range(len(lines)) for j in range(i + 1, len(lines))]
    heapq.heapify(queue)
    alive = set(range(len(lines)))
    while len(alive) > 1:
        _, i, j = heapq.heappop(queue)
        if i not in alive or j not in alive:
            continue
        alive -= {i, j}
        new = len(lines)
        lines.append(np.maximum(lines[i], lines[j]))
        estimates.append(np_estimate(lines[new]))
        # The lent bin belongs on the left edge of every tree that holds it.
        trees.append(trees[j] + trees[i] if holds[j] else trees[i] + trees[j])
        holds.append(holds[i] or holds[j])
        for other in sorted(alive):
            heapq.heappush(queue, (distance(other, new), other, new))
        alive.add(new)
    return [x for x in trees[alive.pop()] if x is not None]


def _share(count: int, correction: float, bins: int) -> int:
    """Values a bin must be sized for when ``count`` values are split over ``bins``."""
    return -(-int(count * correction) // bins)


def simple_layout(space: Workspace, technical_bins: int, path: tuple[int, ...], layout: Layout) -> int:
    """Give each bin at least one technical bin so that the fullest is as small as can be.

    Appends to ``layout`` and returns the fullest technical bin.
    """
    space.validate()
    order = space.positions
    n = len(order)
    technical_bins = technical_bins or sizing.next_multiple_of_64(n)
    if n > technical_bins:
        raise ValueError(f"{n} user bins do not fit into {technical_bins} technical bins")
    spare = technical_bins - n + 1
    widths = np.arange(1, spare + 1)
    share = lambda b: np.array([_share(int(space.counts[b]), space.fpr_correction[w], w) for w in widths])
    # worst[k]: the fullest bin when the bins so far take k technical bins more than they number.
    worst = share(order[0])
    chosen = [None]
    for b in order[1:]:
        own = share(b)
        # Rows: extra bins in total; columns: of these, extra bins given to the bins before.
        total, given = np.arange(spare)[:, None], np.arange(spare)[None, :]
        table = np.where(given <= total, np.maximum(own[np.maximum(total - given, 0)], worst[None, :]), np.iinfo(np.int64).max)
        pick = table.argmin(1)
        chosen.append(pick)
        worst = table[np.arange(spare), pick]
    fullest, size, tb, extra = 0, 0, 0, spare - 1
    for place in range(n - 1, -1, -1):
        left = int(chosen[place][extra]) if place else 0
        width = extra - left + 1
        layout.placed.append((path, tb, width, order[place]))
        each = _share(int(space.counts[order[place]]), space.fpr_correction[width], width)
        if each > size:
            fullest, size = tb, each
        tb, extra = tb + width, left
    return fullest


class _Planner:
    def __init__(self, config: FilterConfig, layout: Layout) -> None:
        self.config, self.layout = config, layout
        self.unions = not config.disable_estimate_union

    def needed(self, bins: int) -> int:
        return sizing.subtract_empty_bins(min(sizing.next_multiple_of_64(bins), self.config.tmax), self.config.empty_bin_fraction)

    def levels(self, merged: int) -> int:
        """Levels it takes to resolve a merge of so many bins."""
        return math.ceil(math.log(merged) / math.log(self.needed(merged)))

    def plan(self, space: Workspace, path: tuple[int, ...], arranged: bool) -> int:
        space.validate()
        config, counts = self.config, space.counts
        if not arranged:
            space.positions = sort_by_cardinality(counts, space.positions)
            if self.unions and not config.disable_rearrangement:
                if space.sketches is None:
                    raise ValueError("sketches are needed to estimate unions or to rearrange")
                space.positions = rearrange(space.sketches, counts, space.positions, config.max_rearrangement_ratio)
        order, n = space.positions, len(space.positions)
        tbs = self.needed(n) if path else sizing.subtract_empty_bins(config.tmax, config.empty_bin_fraction)
        from_tb, from_bin = self._search(space, order, n, tbs)
        return self._trace(space, order, n, tbs, from_tb, from_bin, path)

    def _search(self, space: Workspace, order: list[int], n: int, tbs: int):
        """Fill the tables user bin by user bin; a row is a user bin, a column a technical bin.

        ``fullest``: size of the fullest bin so far; ``deep``: values to be
        resolved further down; ``from_*``: the cell a cell was reached from.
        """
        corr, relaxed, alpha = space.fpr_correction, space.relaxed_correction, self.config.alpha
        counts = np.array([space.counts[p] for p in order], np.int64)
        running = np.concatenate([[0], np.cumsum(counts)])  # running[j]: values of the bins before j
        fullest, deep = np.zeros((n, tbs)), np.zeros((n, tbs))
        from_tb, from_bin = np.zeros((n, tbs), np.int64), np.zeros((n, tbs), np.int64)
        at = np.arange(tbs)
        fullest[0] = np.ceil(np.floor(float(counts[0]) * corr[1 : tbs + 1]) / (at + 1))
        prefix = prefix_estimates(space.sketches, space.counts, order) if self.unions else running[1:]
        levels = np.array([0, 1, *(self.levels(m) for m in range(2, n + 1))])
        for j in range(1, n):
            fullest[j, 0] = int(int(prefix[j]) * relaxed)
            deep[j, 0] = levels[j + 1] * running[j + 1]
            from_bin[j, 0] = j - 1
        if tbs == 1:
            return from_tb, from_bin
        widths = np.maximum(at[:, None] - at[None, :], 1)
        never = at[None, :] >= at[:, None]
        for j in range(1, n):
            union = union_estimates(space.sketches, space.counts, order, j) if self.unions else None
            # Splitting bin j over the technical bins after each earlier one.
            own = np.concatenate([[0], np.ceil(np.floor(float(counts[j]) * corr[1:tbs]) / at[1:])])
            score = np.maximum(own[widths], fullest[j - 1])
            cost = np.floor(score * (at[:, None] + 1) + alpha * deep[j - 1])
            cost[never] = np.inf
            best = cost.argmin(1)
            least, cheapest = score[at, best], cost[at, best]
            tb, bin_, depth = best, np.full(tbs, j - 1), deep[j - 1, best]
            # Merging bins k..j into one technical bin, for k = j - 1 downwards, as long as bin k kept to one.
            open_, high, block = at > 0, j - 1, 32
            while high >= 1 and open_.any():
                ks = np.arange(high, max(0, high - block), -1)
                size_before = union[ks + 1] if self.unions else running[j + 1] - running[ks + 1]
                weight = running[j + 1] - running[ks]
                size = union[ks] if self.unions else weight
                size_before, size = np.floor(relaxed * size_before), np.floor(relaxed * size)
                # Technical bins 1 to ``end`` and their left neighbours, for the bins before k; all of these are slices.
                end = int(np.flatnonzero(open_)[-1]) + 1
                o, here = at[1:end], np.arange(end - 1)
                low = high - len(ks)
                rows = slice(high - 1, low - 1 if low else None, -1)
                score = np.maximum(fullest[rows, : end - 1], size[:, None])
                down = deep[rows, : end - 1] + (levels[j - ks + 1] * weight)[:, None]
                cost = np.floor(score * (o + 1) + alpha * down)
                # What the search would know at each step, had it not stopped before; true up to where it does stop.
                before = np.minimum.accumulate(np.concatenate([cheapest[None, 1:end], cost[:-1]]), 0)
                step = np.arange(len(ks))[:, None]
                chosen = np.maximum.accumulate(np.where(cost < before, step, -1), 0)
                limit = np.empty_like(score)
                limit[0] = least[1:end]
                limit[1:] = np.where(chosen[:-1] < 0, least[1:end], score[chosen[:-1], here])
                stop = (o - from_tb[high:low:-1, 1:end] >= 2) | (size_before[:, None] >= limit)
                stop[0] |= ~open_[1:end]
                last = np.where(stop.any(0), stop.argmax(0), len(ks)) - 1
                pick = np.where(last < 0, -1, chosen[np.maximum(last, 0), here])
                got = np.flatnonzero(pick >= 0)
                to, k = got + 1, pick[got]
                least[to], cheapest[to], depth[to] = score[k, got], cost[k, got], down[k, got]
                tb[to], bin_[to] = to - 1, ks[k] - 1
                open_[1:end] = last == len(ks) - 1
                high, block = low, min(block * 2, 256)
            fullest[j, 1:], deep[j, 1:], from_tb[j, 1:], from_bin[j, 1:] = least[1:], depth[1:], tb[1:], bin_[1:]
        return from_tb, from_bin

    def _trace(self, space, order, n, tbs, from_tb, from_bin, path) -> int:
        """Walk back from the last cell, number the technical bins on the way and plan the merged ones."""
        i, j, tb = tbs - 1, n - 1, 0
        fullest, size = 0, 0

        def note(value: int) -> None:
            nonlocal fullest, size
            if value > size:
                fullest, size = tb, value

        def split(place: int, width: int) -> None:
            self.layout.placed.append((path, tb, width, order[place]))
            note(_share(int(space.counts[order[place]]), space.fpr_correction[width], width))

        def merge(places: list[int]) -> None:
            chosen = [order[p] for p in places]
            below = (*path, tb)
            inner = Workspace(space.counts, chosen, space.fpr_correction, space.relaxed_correction, space.sketches)
            if len(chosen) > self.config.tmax:
                lower = self.plan(inner, below, arranged=False)
            else:
                bins = sizing.subtract_empty_bins(sizing.next_multiple_of_64(len(chosen)), self.config.empty_bin_fraction)
                lower = simple_layout(inner, bins, below, self.layout)
            self.layout.merged.append((below, lower))
            if self.unions:
                total = int(np_estimate(np.maximum.reduce(space.sketches[chosen])))
            else:
                total = sum(int(space.counts[c]) for c in chosen)
            note(int(total * space.relaxed_correction))

        while i > 0 and j > 0:
            back, k = int(from_tb[j, i]), int(from_bin[j, i])
            width = i - back
            if width == 1 and k != j - 1:
                merge(list(range(j, k, -1)))
                i, j = back, k
            else:
                split(j, width)
                i, j = back, j - 1
            tb += width
        if i == 0 and j > 0:
            merge(list(range(j, -1, -1)))
        else:
            split(0, i + 1)
        return fullest


def compute_layout(
    config: FilterConfig, counts: np.ndarray, sketches: np.ndarray | None = None, positions: list[int] | None = None, validate: bool = True
) -> Layout:
    """The layout of ``counts[user_bin]`` values in a tree; ``sketches`` where unions are estimated."""
    if validate:
        config = config.validated()
    counts = np.asarray(counts, np.int64)
    layout = Layout()
    space = Workspace(
        counts,
        list(range(len(counts))) if positions is None else list(positions),
        sizing.fpr_correction(config.maximum_fpr, config.number_of_hash_functions, config.tmax),
        sizing.relaxed_fpr_correction(config.maximum_fpr, config.relaxed_fpr, config.number_of_hash_functions),
        sketches,
    )
    layout.top_max_bin = _Planner(config, layout).plan(space, (), arranged=False)
    layout.merged.sort(key=lambda m: len(m[0]))
    return layout


@dataclass
class Node:
    """A filter of the tree."""

    path: tuple[int, ...]
    max_bin: int
    n_tbs: int = 0
    children: dict[int, Node] = field(default_factory=dict)
    records: list[tuple[int, int, int]] = field(default_factory=list)  # storage_tb, n_tbs, user_bin

    @property
    def favourite(self) -> Node | None:
        """The child behind the fullest technical bin, if that is a merged one."""
        return self.children.get(self.max_bin)


def tree(layout: Layout) -> Node:
    """The filters of a layout as a tree; the record of a filter's fullest bin comes first."""
    root = Node((), layout.top_max_bin)
    for path, max_bin in sorted(layout.merged, key=lambda m: len(m[0])):
        at = root
        for tb in path[:-1]:
            at = at.children[tb]
        at.children[path[-1]] = Node(path, max_bin)
        at.n_tbs = max(at.n_tbs, path[-1] + 1)
    for path, tb, width, user_bin in layout.placed:
        at = root
        for step in path:
            at = at.children[step]
        at.n_tbs = max(at.n_tbs, tb + width)
        at.records.insert(0 if tb == at.max_bin else len(at.records), (tb, width, user_bin))
    return root


def nodes(root: Node) -> list[Node]:
    """All filters, by level and path; the place in the list is the filter's number."""
    out, level = [], [root]
    while level:
        out += level
        level = [n.children[tb] for n in level for tb in sorted(n.children)]
    return out
