"""Removal of long word windows that repeat across documents, by level-wise doubling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.blocks import NULL_ID, Block, Blocks, distinct, flat, grouped, pack, pack_keys, runs, seen_twice, shared_keys, span_columns, split_sorted, unpack
from strata.llm.stats import ids_of
from strata.llm.text import covered, leftmost_min, mix, ranges, slice_hashes, window_hashes, window_ok, word_spans


class _Words:
    """The words of a block and the windows that may repeat elsewhere, level by level.

    Level 1 has a quarter of the window's length. Not every window of that length is
    asked for: the one with the least hash inside each full window is (the same one in
    all equal windows). Level 2 asks for both halves of the windows that are
    left, level 3 for the whole window.
    """

    def __init__(self, block: Block, width: int, counts: list[int]):
        self.block, self.width, self.counts = block, width, counts
        self.starts, self.ends, self.offsets = word_spans(block.data, block.offsets)
        self.hashes = slice_hashes(block.data, self.starts, self.ends)
        self.docs = block.ids[ids_of(self.offsets)]

    def first_level(self) -> tuple[np.ndarray, np.ndarray]:
        """Each full window's start and the key of its least quarter window."""
        quarter = max(1, -(-self.width // 4))
        at = np.flatnonzero(window_ok(self.offsets, self.width))
        if not len(at):
            return at, np.zeros(0, np.uint64)
        grams = window_hashes(self.hashes, quarter)
        # Least hashes crowd at the low end; mixed once more they fill all ranges alike.
        return at, mix(grams[leftmost_min(grams, self.width - quarter + 1)[at]])

    def second_level(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of windows left after level 1, and the keys of their halves."""
        at, keys = self.first_level()
        at = at[self._repeated("quarters", keys, at, self.counts[0])]
        half = -(-self.width // 2)
        halves = window_hashes(self.hashes, half)
        return at, halves[at], halves[at + self.width - half]

    def third_level(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of windows whose halves both repeat, and two independent keys of the whole window."""
        at, left, right = self.second_level()
        both = self._repeated("halves", np.concatenate([left, right]), np.concatenate([at, at]), self.counts[1])
        at = at[both[: len(at)] & both[len(at) :]]
        if not len(at):
            return at, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        other = slice_hashes(self.block.data, self.starts, self.ends, seed=11)
        return at, window_hashes(self.hashes, self.width)[at], window_hashes(other, self.width)[at]

    def _repeated(self, level: str, keys: np.ndarray, at: np.ndarray, count: int) -> np.ndarray:
        known, _, several, place = grouped(keys, self.docs[at])
        return (several | shared_keys(known, self.block.answers.get(level, {}), count))[place]

    def removed(self) -> np.ndarray:
        """Which words a window covers that starts in a document of smaller id too."""
        at, one, two = self.third_level()
        _, least, _, place, order = _whole(one, two, self.docs[at])
        elsewhere = np.zeros(len(least), dtype=bool)
        for bucket, a, b in split_sorted(order, self.counts[2]):
            if bucket in self.block.answers.get("wholes", {}):
                elsewhere[a:b] = np.unpackbits(unpack(self.block.answers["wholes"][bucket])[0], count=b - a).astype(bool)
        dead = elsewhere[place] | (self.docs[at] > least[place]) if len(at) else np.zeros(0, bool)
        return covered(at[dead], self.width, len(self.starts))


def _whole(one: np.ndarray, two: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (two keys): second keys, least doc, first positions, each item's place, first keys (sorted)."""
    order = np.lexsort([two, one])
    a, b = one[order], two[order]
    first = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    heads = np.flatnonzero(first)
    place = np.empty(len(a), np.int64)
    place[order] = np.cumsum(first) - 1
    least = np.minimum.reduceat(docs[order], heads) if len(heads) else docs[:0]
    return b[heads], least, heads, place, a[heads]


def _least_ids(payloads: list[bytes]) -> list[bytes | None]:
    """For each message, the bits of the windows that have a smaller document in another one."""
    parts = [unpack(p) for p in payloads]
    one, two, docs = (np.concatenate([p[k] for p in parts]) for k in range(3))
    _, least, _, place, _ = _whole(one, two, docs)
    bits = least[place] < docs
    out, at = [], 0
    for p in parts:
        own = bits[at : at + len(p[0])]
        out.append(pack(np.packbits(own)) if own.any() else None)
        at += len(p[0])
    return out


def drop_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50) -> DataFrame:
    """One row per document: id, n_words, n_removed, removed_from, removed_to, kept_text.

    Each word that is covered by a window of ``width`` words whose words also
    start, in the same order, in a document with a smaller id is removed; windows are judged on the input. The
    spans count words of the input, their ends exclusive; kept_text has the other words joined by one space.

    Windows repeated at a quarter of the length alone are looked up at half of it,
    and those repeated there at the whole, where two independent 64-bit hashes of the words must agree.
    Each level sends a key once per block, see ``blocks``.

    A null or empty text, and one of fewer words than the window, keeps all
    its words. Ids are integers; a null id comes before all others. Rows with the same id are
    the same document to each other, so nothing is removed for the sake of one of them. An empty table
    gives no rows; other columns are ignored. Hash level keys cover all windows, at any size.
    """
    blocks = Blocks(docs, id_col, text_col, "substring_dedup")
    counts = [blocks.ranges(64 << 20), blocks.ranges(32 << 20), blocks.ranges(16 << 20)]

    def keys(block: Block, level: int) -> Iterator[tuple[int, bytes]]:
        words = _Words(block, width, counts)
        known = distinct(words.first_level()[1] if level == 0 else np.concatenate(words.second_level()[1:]))
        for bucket, a, b in split_sorted(known, counts[level]):
            yield bucket, flat(*pack_keys(known[a:b]))

    def wholes(block: Block) -> Iterator[tuple[int, bytes]]:
        words = _Words(block, width, counts)
        at, one, two = words.third_level()
        second, least, _, _, known = _whole(one, two, words.docs[at])
        for bucket, a, b in split_sorted(known, counts[2]):
            yield bucket, flat(known[a:b], second[a:b], least[a:b])

    def result(block: Block) -> Iterator[pa.RecordBatch]:
        words = _Words(block, width, counts)
        gone = words.removed()
        stays = np.flatnonzero(~gone)
        starts, sizes = words.starts[stays], words.ends[stays] - words.starts[stays]
        out = np.full(int(sizes.sum()) + len(stays), 32, np.uint8)
        ends = np.cumsum(sizes + 1)
        out[ranges(ends - sizes - 1, sizes)] = block.data[ranges(starts, sizes)]
        kept = np.searchsorted(stays, words.offsets)
        edge = np.concatenate([[0], ends])[kept]
        texts = [out[a : max(a, b - 1)].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
        first, last = runs(gone)
        # A run may go on from one document into the next.
        cut = np.setdiff1d(words.offsets[np.isin(words.offsets, np.flatnonzero(gone))], first)
        cut = cut[gone[np.maximum(cut - 1, 0)]]
        first, last = np.sort(np.concatenate([first, cut])), np.sort(np.concatenate([last, cut]))
        spans = span_columns(first, last, words.offsets)
        total = np.diff(words.offsets)
        columns = [pa.array(block.ids), pa.array(total), pa.array(total - np.diff(kept)), *spans, pa.array(texts, pa.binary()).cast(pa.string())]
        names = ["id", "n_words", "n_removed", "removed_from", "removed_to", "kept_text"]
        for at in range(0, len(total), 1000):
            yield pa.RecordBatch.from_arrays([c.slice(at, 1000) for c in columns], names=names)

    blocks.ask("quarters", lambda b: keys(b, 0), seen_twice)
    blocks.ask("halves", lambda b: keys(b, 1), seen_twice)
    blocks.ask("wholes", wholes, _least_ids)
    out = blocks.map(result, "id long, n_words long, n_removed long, removed_from array<long>, removed_to array<long>, kept_text string")
    return out.withColumn("id", F.when(F.col("id") != NULL_ID, F.col("id"))).withColumnRenamed("id", id_col)
