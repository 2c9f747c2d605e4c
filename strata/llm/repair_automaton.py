"""Cheapest edits of role sequences by a weighted automaton that is made deterministic as far as it is needed.

Rows are edited to fit ``(s?(ua)+)?``. Its positions are 0 (nothing yet), 1 (after the system row), 2 (after a user row) and 3 (after an
assistant row); it may end at 0 and 3. The cost of finishing from each position before some row is a vector of four numbers; less its least
number there are only few different ones. They are the states of the deterministic automaton: it reads rows from last to first, and
each transition, kept in a table when first needed, gives the next vector and what was taken off it. The edits are traced the other
way, from the first row on, along arcs whose cost is exactly what the vectors differ by; of several, the first in order of letters.
"""

from __future__ import annotations

import numpy as np

#: Edits by the order of their letters, and what they cost; keeping or changing a truncated row adds TRUNCATED.
DELETE, INSERT, KEEP, RENAME = "D", "I", "K", "R"
COST = {DELETE: 2, INSERT: 5, KEEP: 0, RENAME: 1}
TRUNCATED = 5
#: Faults of rows, in the order in which the first counts; blank and duplicate rows must be deleted.
FAULTS = ("", "blank", "duplicate", "truncated")
#: First letters of the roles; any other is ROLES[3].
ROLES = ("s", "u", "a", "")
#: Position after a user or assistant row, whichever is due.
DUE = (2, 2, 3, 2)
#: Position after a row of a role is kept, where it may be.
KEPT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}
#: Cost of finishing after the last row; a cost that stands for "not possible".
LAST, NEVER = (0, 10, 5, 0), 1 << 20
#: A row is role + 4 * fault.
SYMBOLS = len(ROLES) * len(FAULTS)
EDITS = (DELETE, KEEP, RENAME)


def arcs(at: int, symbol: int) -> dict[str, tuple[int, int]]:
    """Edits of one row at a position: letter -> (cost, next position)."""
    role, fault = symbol % len(ROLES), FAULTS[symbol // len(ROLES)]
    out = {DELETE: (COST[DELETE], at)}
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        if (at, role) in KEPT:
            out[KEEP] = (COST[KEEP] + more, KEPT[at, role])
        out[RENAME] = (COST[RENAME] + more, DUE[at])
    return out


class Automaton:
    """States are normalised vectors; transitions are added when a scan needs them."""

    def __init__(self) -> None:
        self.places: dict[tuple[int, ...], int] = {}
        self.vectors: list[tuple[int, ...]] = []
        self.next = np.full((0, SYMBOLS), -1, np.int32)
        self.off = np.zeros((0, SYMBOLS), np.int64)
        self.codes = np.zeros((0, SYMBOLS, 4), np.uint8)
        self.moves = np.zeros((0, SYMBOLS, 4), np.uint8)

    def state(self, vector: list[int] | tuple[int, ...]) -> tuple[int, int]:
        """The state of a vector, and its least number."""
        least = min(vector)
        own = tuple(v - least if v < NEVER // 2 else NEVER for v in vector)
        if own not in self.places:
            self.places[own] = len(self.vectors)
            self.vectors.append(own)
            if len(self.vectors) > len(self.next):
                grow = lambda a, fill: np.concatenate([a, np.full((len(a) + 16, *a.shape[1:]), fill, a.dtype)])
                self.next, self.off, self.codes, self.moves = grow(self.next, -1), grow(self.off, 0), grow(self.codes, 0), grow(self.moves, 0)
        return self.places[own], least

    def _add(self, state: int, symbol: int) -> None:
        """Before the row: each position's cheapest edit, with inserted rows before it; and the edits themselves."""
        after = self.vectors[state]
        ways = [{letter: cost + after[to] for letter, (cost, to) in arcs(q, symbol).items()} for q in range(4)]
        row = [min(w.values()) for w in ways]
        best = [min(row[q], COST[INSERT] + row[DUE[q]], 2 * COST[INSERT] + row[DUE[DUE[q]]]) for q in range(4)]
        for q in range(4):
            if best[q] >= NEVER // 2:
                continue  # no conversation ends like this
            at, inserts = q, 0
            while ways[at][DELETE] != best[at] and best[at] == COST[INSERT] + best[DUE[at]]:
                at, inserts = DUE[at], inserts + 1
            letter = next(x for x in EDITS if ways[at].get(x) == best[at])
            self.codes[state, symbol, q] = len(EDITS) * inserts + EDITS.index(letter)
            self.moves[state, symbol, q] = arcs(at, symbol)[letter][1]
        to, least = self.state(best)
        self.next[state, symbol], self.off[state, symbol] = to, least

    def scan(self, symbols: np.ndarray, offsets: np.ndarray, states: np.ndarray, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """From the state after each sequence [offsets[i], offsets[i + 1]): the state before it and the sum taken off. ``kept`` gets the state after every row."""
        states, total, sizes = states.copy(), np.zeros(len(states), np.int64), np.diff(offsets)
        order = np.argsort(-sizes, kind="stable")
        longer = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(sizes.max(initial=0)), side="right")
        for k, n in enumerate(longer):
            own = order[:n]
            at = offsets[own + 1] - 1 - k
            s, x = states[own], symbols[at]
            for pair in np.unique((s * SYMBOLS + x)[self.next[s, x] < 0]).tolist():
                self._add(*divmod(pair, SYMBOLS))
            if kept is not None:
                kept[at] = s
            total[own] += self.off[s, x]
            states[own] = self.next[s, x]
        return states, total

    def trace(self, symbols: np.ndarray, offsets: np.ndarray, kept: np.ndarray) -> np.ndarray:
        """For every row and each position that its sequence may begin at: the row's edit and the inserts before it, as EDITS place + 3 * inserts."""
        out, sizes = np.zeros((len(symbols), 4), np.uint8), np.diff(offsets)
        at = np.tile(np.arange(4), (len(sizes), 1))
        order = np.argsort(-sizes, kind="stable")
        longer = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(sizes.max(initial=0)), side="right")
        for k, n in enumerate(longer):
            own = order[:n]
            row = offsets[own] + k
            s, x = kept[row][:, None], symbols[row][:, None]
            out[row] = self.codes[s, x, at[own]]
            at[own] = self.moves[s, x, at[own]]
        return out

    def matrices(self, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each sequence the cheapest way from every position before it to every position after it (n x 4 x 4)."""
        n = len(offsets) - 1
        out = np.empty((n, 4, 4), np.int64)
        for q in range(4):
            unit, _ = self.state([0 if k == q else NEVER for k in range(4)])
            states, total = self.scan(symbols, offsets, np.full(n, unit))
            before = np.array(self.vectors)[states] if n else np.zeros((0, 4), np.int64)
            out[:, :, q] = np.where(before < NEVER // 2, before + total[:, None], NEVER)
        return out


def before(matrix: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The vector before a sequence, from its matrix and the vector after it."""
    return np.minimum((matrix + after[None, :]).min(axis=1), NEVER)
