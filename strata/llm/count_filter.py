"""A log-frequency Bloom filter: quantised counts read by repeated membership probes (numpy)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from strata.llm.text import mix

_LEVEL, _PROBE = 0xA24BAED4963EE407, 0x9FB21C651E98DF25


def level_of(counts: np.ndarray, least: int) -> np.ndarray:
    """1 for counts from least, one more with every doubling; 0 below."""
    return np.where(counts >= least, 1 + np.floor(np.log2(np.maximum(counts, 1) / least) + 1e-9), 0).astype(np.int64)


def twice_count_of(levels: np.ndarray, least: int) -> np.ndarray:
    """Twice the middle of the counts of a level, a whole number; 0 for level 0."""
    return np.where(levels > 0, 3 * least * (np.int64(1) << np.maximum(levels - 1, 0)) - 1, 0)


def _bit(keys: np.ndarray, level: int, probe: int, bits: np.ndarray) -> np.ndarray:
    spread = mix(keys + np.uint64((_LEVEL * level + _PROBE * probe) % 2**64))
    return (((spread >> np.uint64(32)) * bits.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)


def build_segment(keys: np.ndarray, levels: np.ndarray, bits_each: int, probes: int) -> np.ndarray:
    """Packed bits of one segment that holds each key at all levels up to its own."""
    size = np.array(max(64, -(-int(levels.sum()) * bits_each // 64) * 64))
    bits = np.zeros(int(size), dtype=bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        own = keys[levels >= level]
        for probe in range(probes):
            bits[_bit(own, level, probe, size)] = True
    return np.packbits(bits)


@dataclass
class CountFilter:
    """Segments end to end; a key belongs to the segment of its hash range."""

    data: np.ndarray
    first: np.ndarray
    bits: np.ndarray
    probes: int

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key: the last for which all probes of it and of those before are set."""
        out = np.zeros(len(keys), np.int64)
        segment = (((keys >> np.uint64(32)) * np.uint64(len(self.bits))) >> np.uint64(32)).astype(np.int64)
        left = np.flatnonzero(self.bits[segment] > 0)
        level = 0
        while len(left):
            level += 1
            for probe in range(self.probes):
                at = _bit(keys[left], level, probe, self.bits[segment[left]])
                byte = self.data[self.first[segment[left]] + (at >> 3)]
                left = left[(byte >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1]
            out[left] = level
        return out
