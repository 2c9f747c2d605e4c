"""Blockwise suffix sorting with a difference cover (numpy)."""

from __future__ import annotations

import numpy as np

#: A difference cover modulo 7: any two residues have a shift under 7 that brings both into it.
PERIOD, COVER = 7, (1, 2, 4)
_IN = np.isin(np.arange(2 * PERIOD) % PERIOD, COVER)
#: For residues a and b the least such shift.
SHIFT = np.array([[next(s for s in range(PERIOD) if _IN[a + s] and _IN[b + s]) for b in range(PERIOD)] for a in range(PERIOD)])
_PLACE = np.array([COVER.index(r) if r in COVER else -1 for r in range(PERIOD)])


def _dense(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks from 1 by value, and the number of values."""
    order = np.argsort(keys).astype(np.uint32)
    ranked = keys[order]
    step = np.ones(len(keys), bool)
    step[1:] = ranked[1:] != ranked[:-1]
    out = np.empty(len(keys), np.uint32)
    out[order] = np.cumsum(step, dtype=np.uint32)
    return out, int(step.sum())


class CoverRanks:
    """Ranks of the text's cover-sample suffixes by their first ``depth`` bytes at least.

    Start with 7 bytes at each sample position, then double: a sample position plus a
    multiple of 7 is one again.
    """

    def __init__(self, text: np.ndarray, depth: int):
        self.n = len(text)
        padded = np.concatenate([text, np.zeros(PERIOD + 9, np.uint8)])
        self.word = np.ndarray((self.n + PERIOD + 1,), dtype=">u8", buffer=padded, strides=(1,))
        periods = self.n // PERIOD + 1
        at = (np.arange(periods)[:, None] * PERIOD + np.array(COVER)).ravel()
        at = np.minimum(at, self.n)
        rank, kinds = _dense(self.word[at].astype(np.uint64) >> np.uint64(8))
        have, hop = PERIOD, len(COVER)
        while have < depth and kinds < len(at):
            both = rank.astype(np.uint64) << np.uint64(32)
            both[: max(0, len(rank) - hop)] |= rank[hop:]
            rank, kinds = _dense(both)
            have, hop = 2 * have, 2 * hop
        self.rank = rank

    def of(self, positions: np.ndarray) -> np.ndarray:
        """Ranks at sample positions; past the end they are 0."""
        at = positions // PERIOD * len(COVER) + _PLACE[positions % PERIOD]
        return np.where(at < len(self.rank), self.rank[np.minimum(at, len(self.rank) - 1)], 0).astype(np.uint64)

    def order(self, positions: np.ndarray) -> np.ndarray:
        """The positions by their suffixes: by 8 bytes first, then long ties by the ranks of sample positions."""
        words = self.word[positions].astype(np.uint64)
        order = np.argsort(words, kind="stable")
        positions, words = positions[order], words[order]
        tied = np.zeros(len(words) + 1, dtype=bool)
        tied[1:-1] = words[1:] == words[:-1]
        group = np.cumsum(~tied[:-1]).astype(np.uint64)
        members = np.flatnonzero(tied[:-1] | tied[1:])
        if not len(members):
            return positions
        own, tie = positions[members], group[members] << np.uint64(32)
        residue = own % PERIOD
        smaller = np.zeros(len(own), np.int64)
        kinds = [np.flatnonzero(residue == r) for r in range(PERIOD)]
        for b in range(PERIOD):
            if not len(kinds[b]):
                continue
            for shift in sorted(set(SHIFT[:, b].tolist())):
                against = np.sort(tie[kinds[b]] | self.of(own[kinds[b]] + shift))
                for a in np.flatnonzero(SHIFT[:, b] == shift):
                    if len(kinds[a]):
                        keys = tie[kinds[a]] | self.of(own[kinds[a]] + shift)
                        smaller[kinds[a]] += np.searchsorted(against, keys) - np.searchsorted(against, tie[kinds[a]])
        resolved = np.lexsort([smaller, tie])
        positions[members] = own[resolved]
        return positions

    def equal_next(self, ordered: np.ndarray, width: int) -> np.ndarray:
        """Whether each suffix and the next in order share their first ``width`` bytes (from 8), compared as bytes."""
        same = np.arange(max(0, len(ordered) - 1))
        for at in (*range(0, width - 7, 8), width - 8):
            same = same[self.word[ordered[same] + at] == self.word[ordered[same + 1] + at]]
        out = np.zeros(max(0, len(ordered) - 1), dtype=bool)
        out[same] = True
        return out


def repeated_later(text: np.ndarray, positions: np.ndarray, width: int, bucket: int = 1 << 18) -> np.ndarray:
    """For each ascending position, whether its ``width`` bytes also stand at a smaller one of them.

    Suffix buckets are ranges of the first 8 bytes of at most about ``bucket``
    suffixes (more only where they are equal in all 8), sorted one at a time.
    """
    out = np.zeros(len(positions), dtype=bool)
    if not len(positions):
        return out
    ranks = CoverRanks(text, width)
    words = ranks.word[positions].astype(np.uint64)
    parts = -(-len(positions) // bucket)
    picks = np.sort(words[:: max(1, len(words) // (64 * parts))])
    splitters = np.unique(picks[len(picks) * np.arange(1, parts) // parts]) if parts > 1 else picks[:0]
    where = np.searchsorted(splitters, words, side="right")
    by = np.argsort(where, kind="stable")
    edges = np.searchsorted(where[by], np.arange(len(splitters) + 2))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if a == b:
            continue
        ordered = ranks.order(positions[by[a:b]])
        same = ranks.equal_next(ordered, width)
        heads = np.flatnonzero(np.concatenate([[True], ~same]))
        first = np.minimum.reduceat(ordered, heads)
        later = ordered != np.repeat(first, np.diff(np.append(heads, len(ordered))))
        out[np.searchsorted(positions, ordered[later])] = True
    return out
