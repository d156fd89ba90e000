"""Cheapest repair of a sequence of turns, by the method of the Four Russians.

Turns are symbols: what initial the role has (s, u, a or another), whether the text is cut off, or that the turn must go.
A state says what the repaired turns end with: nothing, s, u or a. The cost vector of a place holds, for each state, the
cheapest cost of repairing what follows. Less its minimum there are only few such vectors, so the effect of each block of
BLOCK symbols on each of them is computed once, and a sequence is processed a block at a time by looking it up, from the
end to the start. To name the edits, each block is expanded backward again from the vector to its right and walked
forward, taking the ASCII-least edit of the cheapest ones: an edit leads to one state only, so that is the least audit.
"""

from __future__ import annotations

from functools import cache, lru_cache

import numpy as np

KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
CUT_OFF = 3  # more for a kept or reroled turn whose text is cut off
INITIALS = "sua"
OTHER = 3
GONE = 8  # the symbol of a turn that must be deleted; the others are 2 * initial + cut off
SYMBOLS = 9
BLOCK = 4
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: For each state, the role that may follow as an inserted or reroled turn, and the state after it.
NEXT_ROLE = ("user", "user", "assistant", "user")
NEXT_STATE = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
#: For each state, the state after a kept turn with initial s, u, a or another; -1 where it may not stand.
KEPT_STATE = ((AFTER_S, AFTER_U, -1, -1), (-1, AFTER_U, -1, -1), (-1, -1, AFTER_A, -1), (-1, AFTER_U, -1, -1))
FAR = 1 << 20


def symbol(initial: str, cut_off: bool) -> int:
    at = INITIALS.find(initial) if initial else -1
    return 2 * (at if at >= 0 else OTHER) + bool(cut_off)


def _with_inserts(v: list[int]) -> list[int]:
    """The cheapest costs if turns may be inserted first."""
    u, a = min(v[AFTER_U], INSERT + v[AFTER_A]), min(v[AFTER_A], INSERT + v[AFTER_U])
    return [min(v[START], INSERT + u), min(v[AFTER_S], INSERT + u), u, a]


def _options(state: int, s: int):
    """(letter, cost, state after it) of each edit of a turn, in ASCII order."""
    yield "D", DELETE, state
    if s != GONE:
        extra = CUT_OFF * (s % 2)
        after = KEPT_STATE[state][s // 2]
        if after >= 0:
            yield "K", KEEP + extra, after
        yield "R", REROLE + extra, NEXT_STATE[state]


def _before(v: tuple[int, ...], s: int) -> list[int]:
    return _with_inserts([min(cost + v[after] for _, cost, after in _options(q, s)) for q in range(4)])


class Tables:
    """The normalised vectors, and the effect of each symbol and of each block on each of them."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        end = tuple(_with_inserts([0, FAR, FAR, 0]))
        self.vectors, to, cost = [end], [], []
        known = {end: 0}
        for v in self.vectors:  # grows while it is read
            to.append([])
            cost.append([])
            for s in range(SYMBOLS):
                found = _before(v, s)
                least = min(found)
                found = tuple(x - least for x in found)
                if found not in known:
                    known[found] = len(self.vectors)
                    self.vectors.append(found)
                to[-1].append(known[found])
                cost[-1].append(least)
        self.to, self.cost = np.array(to, np.int32), np.array(cost, np.int64)
        self.block_to, self.block_cost = self.to, self.cost
        for _ in range(block - 1):
            first_to = self.to[self.block_to].transpose(0, 2, 1)  # vector, first symbol, rest
            first_cost = self.cost[self.block_to].transpose(0, 2, 1) + self.block_cost[:, None, :]
            n = len(self.vectors)
            self.block_to, self.block_cost = first_to.reshape(n, -1), first_cost.reshape(n, -1)
        self._walk = lru_cache(1 << 16)(self._walk_once)

    def blocks(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the whole blocks, and the symbols left over at the end."""
        n = len(symbols) // self.block
        powers = SYMBOLS ** np.arange(self.block - 1, -1, -1)
        whole = symbols[: n * self.block].reshape(n, self.block).astype(np.int64) @ powers
        return whole, symbols[n * self.block :]

    def effect(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each vector to the right of the symbols, the vector to their left and the cost added."""
        v, cost = np.arange(len(self.vectors)), np.zeros(len(self.vectors), np.int64)
        whole, rest = self.blocks(symbols)
        for s in rest[::-1]:
            cost += self.cost[v, s]
            v = self.to[v, s]
        for b in whole[::-1]:
            cost += self.block_cost[v, b]
            v = self.block_to[v, b]
        return v, cost

    def _walk_once(self, symbols: bytes, right: int, state: int) -> tuple[str, int]:
        """The edits of one block's symbols from a state, and the state after them."""
        seen, total = [right], [0]
        for s in reversed(symbols):
            total.append(total[-1] + int(self.cost[seen[-1], s]))
            seen.append(int(self.to[seen[-1], s]))
        seen.reverse()
        total.reverse()
        out = []
        for i, s in enumerate(symbols):
            after = self.vectors[seen[i + 1]]
            while True:
                left = total[i] - total[i + 1] + self.vectors[seen[i]][state]
                letters = [(letter, q) for letter, cost, q in _options(state, s) if cost + after[q] == left]
                insert = INSERT + self.vectors[seen[i]][NEXT_STATE[state]] == self.vectors[seen[i]][state]
                if insert and not (letters and letters[0][0] < "I"):
                    out.append("I")
                    state = NEXT_STATE[state]
                    continue
                out.append(letters[0][0])
                state = letters[0][1]
                break
        return "".join(out), state

    def walk(self, symbols: np.ndarray, right: int, state: int) -> tuple[str, int]:
        """The ASCII-least of the cheapest edits of the symbols from a state, and the state after them."""
        whole, rest = self.blocks(symbols)
        edge = right
        for s in rest[::-1]:
            edge = self.to[edge, s]
        edges = [int(edge)]
        for b in whole[::-1]:
            edges.append(int(self.block_to[edges[-1], b]))
        edges.reverse()
        out = []
        raw = symbols.astype(np.uint8).tobytes()
        for k in range(len(whole)):
            letters, state = self._walk(raw[k * self.block : (k + 1) * self.block], edges[k + 1], state)
            out.append(letters)
        letters, state = self._walk(raw[len(whole) * self.block :], right, state)
        return "".join(out) + letters, state

    def ending(self, state: int) -> str:
        """What is inserted after the last turn."""
        return {START: "", AFTER_A: "", AFTER_U: "I", AFTER_S: "II"}[state]

    def repaired(self, symbols: np.ndarray) -> tuple[int, str]:
        """Cost and audit of a whole conversation."""
        left, cost = self.effect(symbols)
        letters, state = self.walk(symbols, 0, START)
        return int(cost[0]) + self.vectors[left[0]][START], letters + self.ending(state)


@cache
def tables() -> Tables:
    return Tables()
