"""Where documents of given lengths go: a packing of lengths, not of rows.

Lengths are whole numbers up to the capacity, so all that is known of any corpus is a table of at most `capacity`
counts. Everything here works on that table and on runs of equal bins, and costs the same for any number of documents.

1. Lengths equal to the capacity are bins of their own. The other large ones, sorted, are cut into GROUPS groups of
   equal cardinality, and every length of a group is rounded up to the group's largest.
2. Configurations of these few sizes: columns of the linear programme "as few bins as can be" are generated by a
   knapsack on its prices until none helps; whole multiples of them are used, the rest goes in largest first.
3. Documents are substituted: the slots of a group take its documents in descending order, and what a bin has left is
   counted with their real lengths.
4. Bins whose real lengths leave more than a share LOOSE of the bin free are given up again. Their lengths and the
   small ones, largest first, go into the tightest bins that hold them, or into new ones.

Several numbers of groups, limits between small and large and shares LOOSE are tried; the plan with the fewest bins is
taken.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np

GROUPS = (64, 128)
SMALL = (1 / 4, 1 / 2)
LOOSE = (0, 1 / 256, 1 / 64, 1 / 16, 1)
TOLERANCE = 1e-9


@dataclass
class Run:
    """`times` bins that hold the same lengths."""

    times: int
    lengths: list[int]
    free: int


def grouped(counts: dict[int, int], groups: int) -> list[tuple[int, list[list[int]]]]:
    """(rounded size, runs [length, count] in descending order) of each group, groups in descending order."""
    total = sum(counts.values())
    cuts = [total * g // groups for g in range(1, groups + 1)]
    out: list[tuple[int, list[list[int]]]] = []
    at, g = 0, 0
    opened = False
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            while cuts[g] <= at:
                g, opened = g + 1, False
            take = min(left, cuts[g] - at)
            if not opened and not (out and out[-1][0] == length):
                out.append((length, []))
            opened = True
            runs = out[-1][1]
            if runs and runs[-1][0] == length:
                runs[-1][1] += take
            else:
                runs.append([length, take])
            at, left = at + take, left - take
    return out


def _knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The dearest multiset of sizes that fits: its price, and how often it has each size."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    for c in range(int(sizes.min()), capacity + 1):
        fits = np.flatnonzero(sizes <= c)
        worth = best[c - sizes[fits]] + prices[fits]
        k = int(worth.argmax())
        if worth[k] > best[c - 1] + TOLERANCE:
            best[c], choice[c] = worth[k], fits[k]
        else:
            best[c] = best[c - 1]
    column, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            column[choice[c]] += 1
            c -= sizes[choice[c]]
    return float(best[capacity]), column


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 600) -> list[tuple[list[int], int]]:
    """[(how often each size occurs in a bin, number of such bins)]; together they have exactly the demand."""
    s, b = np.array(sizes), np.array(demand, float)
    columns = np.diag((capacity // s).astype(float))
    inverse = np.diag(1 / (capacity // s))
    used = inverse @ b
    for _ in range(rounds):  # each round leaves a valid programme, so the limit bounds time, not correctness
        prices = inverse.sum(0)
        worth, column = _knapsack(s, prices, capacity)
        if worth <= 1 + 1e-7:
            break
        step = inverse @ column
        rising = step > TOLERANCE
        ratio = np.where(rising, used / np.where(rising, step, 1), np.inf)
        out = int(ratio.argmin())
        columns[:, out] = column
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
        used -= step * ratio[out]
        used[out] = ratio[out]
    left = np.array(demand, np.int64)
    chosen = []
    for k in np.argsort(-used):
        column = columns[:, k].astype(np.int64)
        held = column > 0
        times = int(min(np.floor(used[k] + 1e-6), (left[held] // column[held]).min()))
        if times > 0:
            chosen.append((column.tolist(), times))
            left -= times * column
    while left.any():  # largest first, as many equal bins at a time as there are documents for
        column, room = np.zeros(len(s), np.int64), capacity
        for k in np.argsort(-s, kind="stable"):
            column[k] = min(left[k], room // s[k])
            room -= int(column[k] * s[k])
        held = column > 0
        times = int((left[held] // column[held]).min())
        chosen.append((column.tolist(), times))
        left -= times * column
    return chosen


def _taken(runs: list[list[int]], n: int) -> list[list[int]]:
    """The next n documents of a group, as runs [length, count]."""
    out = []
    while n:
        k = min(n, runs[0][1])
        out.append([runs[0][0], k])
        runs[0][1] -= k
        n -= k
        if not runs[0][1]:
            runs.pop(0)
    return out


def substituted(groups: list[tuple[int, list[list[int]]]], chosen: list[tuple[list[int], int]], capacity: int) -> list[Run]:
    """Runs of bins with the groups' real lengths in the slots of the configurations."""
    left = [[list(r) for r in runs] for _, runs in groups]
    out = []
    for column, times in chosen:
        slots = [_taken(left[g], times) for g, n in enumerate(column) for _ in range(n)]
        at = 0
        while at < times:
            n = min(s[0][1] for s in slots)
            lengths = [s[0][0] for s in slots]
            out.append(Run(n, lengths, capacity - sum(lengths)))
            for s in slots:
                s[0][1] -= n
                if not s[0][1]:
                    s.pop(0)
            at += n
    return out


def _tight(bins: list[Run], small: dict[int, int], limit: float) -> tuple[list[Run], dict[int, int]]:
    """The bins with at most `limit` free, and the small lengths together with those of the other bins."""
    again = dict(small)
    for run in bins:
        if run.free > limit:
            for length in run.lengths:
                again[length] = again.get(length, 0) + run.times
    return [run for run in bins if run.free <= limit], again


def best_fit(bins: list[Run], small: dict[int, int], capacity: int) -> list[Run]:
    """`bins` with the small lengths added, each into the bin it leaves least room in."""
    by_free: dict[int, list[Run]] = {}
    for run in bins:
        by_free.setdefault(run.free, []).append(run)
    rooms = sorted(by_free)

    def put(run: Run) -> None:
        if run.free not in by_free:
            by_free[run.free] = []
            bisect.insort(rooms, run.free)
        by_free[run.free].append(run)

    for length in sorted(small, reverse=True):
        left = small[length]
        while left:
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):
                each = min(capacity // length, left)
                put(Run(left // each, [length] * each, capacity - length * each))
                left %= each
                continue
            room = rooms[k]
            run = by_free[room].pop()
            if not by_free[room]:
                del by_free[room]
                rooms.pop(k)
            each = min(room // length, left)  # the bin stays the tightest one as long as another fits
            n = min(run.times, left // each)
            if run.times > n:
                put(Run(run.times - n, run.lengths, run.free))
            put(Run(n, run.lengths + [length] * each, room - length * each))
            left -= n * each
    return [run for room in rooms for run in by_free[room]]


def planned(counts: dict[int, int], capacity: int) -> list[Run]:
    """Runs of bins that hold `counts[length]` documents of each length from 1 to the capacity."""
    counts = {length: n for length, n in counts.items() if n > 0}
    if any(not 1 <= length <= capacity for length in counts):
        raise ValueError("a length outside the capacity")
    full = [Run(counts[capacity], [capacity], 0)] if capacity in counts else []
    rest = {length: n for length, n in counts.items() if length < capacity}
    best: list[Run] | None = None
    for share in SMALL:
        large = {length: n for length, n in rest.items() if length > share * capacity}
        small = {length: n for length, n in rest.items() if length <= share * capacity}
        for k in GROUPS if large else GROUPS[:1]:
            groups = grouped(large, k) if large else []
            chosen = configurations([s for s, _ in groups], [sum(n for _, n in r) for _, r in groups], capacity) if groups else []
            placed = substituted(groups, chosen, capacity)
            for loose in LOOSE:
                kept, again = _tight(placed, small, loose * capacity)
                bins = best_fit(kept, again, capacity)
                if best is None or sum(r.times for r in bins) < sum(r.times for r in best):
                    best = bins
    return full + (best or [])
