"""Removal of byte strings that occur before, by blockwise suffix sorting with a difference cover."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.blocks import NULL_ID, Block, Blocks, distinct, flat, grouped, pack, pack_keys, runs, seen_twice, shared_keys, span_columns, split_sorted, unpack, unpack_keys
from strata.llm.suffix import repeated_later
from strata.llm.text import covered, gather, leftmost_min, mix, pair, ranges, slice_hashes, window_ok

#: Bytes of the grams that name a suffix bucket.
GRAM = 32
#: Positions that are hashed at a time.
STEP = 1 << 16
#: A gram in this many different contexts, about, is split by whole windows.
HEAVY = 64


def first_equal(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each slice the first one (by index) with the same key and bytes; hashes find it, bytes decide."""
    hashes = pair(slice_hashes(data, starts, ends), keys)
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    head = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(order) else np.zeros(0, bool)
    out = np.empty(len(order), np.int64)
    out[order] = order[np.flatnonzero(head)[np.cumsum(head) - 1]] if len(order) else 0
    for at in range(0, len(out), 1 << 12):
        own = np.arange(at, min(len(out), at + (1 << 12)))
        own = own[out[own] != own]
        sizes = ends[own] - starts[own]
        fits = (ends[out[own]] - starts[out[own]] == sizes) & (keys[own] == keys[out[own]])
        out[own[~fits]] = own[~fits]
        own, sizes = own[fits], sizes[fits]
        differ = data[ranges(starts[own], sizes)] != data[ranges(starts[out[own]], sizes)]
        wrong = own[np.unique(np.repeat(np.arange(len(own)), sizes)[differ])]
        out[wrong] = wrong
    return out


def _gram_keys(words: list[np.ndarray]) -> np.ndarray:
    """Keys of grams from their 8-byte words."""
    out = words[0] * np.uint64(0x9E3779B97F4A7C15)
    for word, factor in zip(words[1:], (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93), strict=True):
        out ^= out >> np.uint64(29)
        out += word * np.uint64(factor)
    return mix(out)


@dataclass
class Counts:
    """Hash ranges of the three questions, and how many different contexts make a gram heavy."""

    grams: int
    windows: int
    suffixes: int
    heavy: int = HEAVY


class _Suffixes:
    """The suffixes of a block's documents with a full window, by suffix bucket.

    A suffix's bucket is the least 32-byte gram of its window, so equal windows share it.
    The suffixes that share one gram's occurrence are neighbours and travel as one
    context: the bytes from the first one's start to the last one's window's end.
    Where a gram has many different contexts (a line that many documents share) its suffixes are
    dealt anew: each window goes by itself, keyed by all its bytes, if it occurs elsewhere. What reaches out of a shared line stays behind, and equal windows of a
    block travel once.
    """

    def __init__(self, block: Block, width: int, counts: Counts):
        self.block, self.width, self.counts = block, width, counts
        self.docs = block.ids
        ok = window_ok(block.offsets, width)
        if not ok.any():
            self.first = self.sizes = self.owner = np.zeros(0, np.int64)
            self.keys = np.zeros(0, np.uint64)
            return
        words = np.ndarray((len(block.data) - 7,), dtype="<u8", buffer=block.data, strides=(1,))
        anchor = np.empty(len(block.data) - width + 1, np.uint32)
        for a in range(0, len(anchor), STEP):  # in steps that stay in the processor's cache
            b = min(a + STEP, len(anchor))
            grams = _gram_keys([words[a + k : b + k + width - GRAM] for k in range(0, GRAM, 8)])
            anchor[a:b] = leftmost_min(grams, width - GRAM + 1) + a
        # A context begins where the gram's place changes or a text begins, and ends before the next one or its text's end.
        new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        new[1:] |= ~ok[:-1]
        self.first = np.flatnonzero(new & ok)
        self.sizes = np.flatnonzero(ok & np.concatenate([new[1:] | ~ok[1:], [True]])) + 1 - self.first
        place = anchor[self.first].astype(np.int64)
        # Least hashes crowd at the low end; mixed once more they fill all ranges alike.
        self.keys = mix(_gram_keys([words[place + k] for k in range(0, GRAM, 8)]))
        self.owner = np.searchsorted(block.offsets, self.first, side="right") - 1
        self.words = words

    def _kinds(self, first: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct keys of contexts, how many different contexts each seems to have here (255 at most), and a byte of one's signature."""
        if not len(keys):
            return keys, np.zeros(0, np.uint8), np.zeros(0, np.uint8)
        ends = first + sizes + self.width - 9
        sign = (mix(self.words[first] + self.words[ends] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8)
        order = np.lexsort([sign, keys])
        keys, sign = keys[order], sign[order]
        head = np.concatenate([[True], keys[1:] != keys[:-1]])
        fresh = head | np.concatenate([[True], sign[1:] != sign[:-1]])
        heads = np.flatnonzero(head)
        return keys[heads], np.minimum(np.add.reduceat(fresh.astype(np.int64), heads), 255).astype(np.uint8), sign[heads]

    def _hits(self, keys: np.ndarray, name: str, ranges_: int) -> tuple[np.ndarray, np.ndarray]:
        """Contexts whose key occurs elsewhere, and those of them with a heavy one."""
        known, _, _, place = grouped(keys, np.arange(len(keys)))
        hit, heavy = np.bincount(place, minlength=len(known)) > 1, np.zeros(len(known), bool)
        for bucket, a, b in split_sorted(known, ranges_):
            if bucket in self.block.answers.get(name, {}):
                found, split = (np.unpackbits(x, count=b - a).astype(bool) for x in unpack(self.block.answers[name][bucket]))
                hit[a:b] |= found
                heavy[a:b] = split
        hit |= heavy
        return np.flatnonzero((hit & ~heavy)[place]), np.flatnonzero(heavy[place])

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self._kinds(self.first, self.sizes, self.keys)

    def _elsewhere(self, keys: np.ndarray, name: str) -> np.ndarray:
        """Which keys occur again in this block or, by the answers, in another."""
        known, _, _, place = grouped(keys, np.arange(len(keys)))
        return ((np.bincount(place, minlength=len(known)) > 1) | shared_keys(known, self.block.answers.get(name, {}), self.counts.windows))[place]

    def windows(self, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte and key of each window of the heavy contexts."""
        first = ranges(self.first[heavy], self.sizes[heavy])
        keys = np.empty(len(first), np.uint64)
        for at in range(0, len(first), STEP):
            keys[at : at + STEP] = slice_hashes(self.block.data, first[at : at + STEP], first[at : at + STEP] + self.width)
        return first, mix(keys + np.uint64(2))

    def window_keys(self) -> np.ndarray:
        """Their sorted distinct keys."""
        return distinct(self.windows(self._hits(self.keys, "grams", self.counts.grams)[1])[1])

    def in_use(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Contexts whose gram occurs elsewhere, by gram and then place: first start, size, key, document, and of each the first equal one."""
        light, heavy = self._hits(self.keys, "grams", self.counts.grams)
        first, sizes, keys = self.first[light], self.sizes[light], self.keys[light]
        if len(heavy):
            starts, own = self.windows(heavy)
            used = self._elsewhere(own, "windows")
            first, sizes, keys = np.concatenate([first, starts[used]]), np.concatenate([sizes, np.ones(int(used.sum()), np.int64)]), np.concatenate([keys, own[used]])
        owner = np.searchsorted(self.block.offsets, first, side="right") - 1
        order = np.lexsort([first - self.block.offsets[owner], self.docs[owner], keys])
        first, sizes, keys, owner = first[order], sizes[order], keys[order], owner[order]
        return first, sizes, keys, owner, first_equal(self.block.data, first, first + sizes + self.width - 1, keys)

    def contexts(self) -> Iterator[tuple[int, bytes]]:
        """The distinct contexts in use, for their buckets' ranges."""
        first, sizes, keys, owner, equal = self.in_use()
        own = np.flatnonzero(equal == np.arange(len(equal)))
        first, sizes, keys, owner = first[own], sizes[own], keys[own], owner[own]
        lengths = sizes + self.width - 1
        inside = first - self.block.offsets[owner]
        for bucket, a, b in split_sorted(keys, self.counts.suffixes):
            data = gather(self.block.data, first[a:b], lengths[a:b])
            yield bucket, flat(keys[a:b], self.docs[owner[a:b]], inside[a:b], sizes[a:b].astype(np.int32), data)

    def removed(self) -> np.ndarray:
        """Which bytes a window covers that also starts earlier."""
        first, sizes, keys, _, equal = self.in_use()
        later = equal != np.arange(len(equal))
        dead = [ranges(first[later], sizes[later])]
        first, sizes, keys = first[~later], sizes[~later], keys[~later]
        for bucket, a, b in split_sorted(keys, self.counts.suffixes):
            if bucket in self.block.answers.get("suffixes", {}):
                starts = ranges(first[a:b], sizes[a:b])
                dead.append(starts[np.unpackbits(unpack(self.block.answers["suffixes"][bucket])[0], count=len(starts)).astype(bool)])
        return covered(np.concatenate(dead), self.width, len(self.block.data))


def seen_grams(payloads: list[bytes], heavy: int) -> list[bytes | None]:
    """For each message of grams, the bits of those that another message has too, and of those in ``heavy`` different contexts or more."""
    parts = [unpack(p) for p in payloads]
    own = [unpack_keys(p[2:]) for p in parts]
    keys, kinds, sign = np.concatenate(own), np.concatenate([p[0] for p in parts]).astype(np.int64), np.concatenate([p[1] for p in parts])
    order = np.lexsort([sign, keys])
    ranked, sign = keys[order], sign[order]
    head = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    fresh = head | np.concatenate([[True], sign[1:] != sign[:-1]])
    heads = np.flatnonzero(head)
    known, several = ranked[heads], np.diff(np.append(heads, len(ranked))) > 1
    many = np.add.reduceat(kinds[order] - 1 + fresh, heads) >= heavy
    out: list[bytes | None] = []
    for k in own:
        at = np.searchsorted(known, k)
        out.append(pack(np.packbits(several[at]), np.packbits(many[at])) if (several | many)[at].any() else None)
    return out


def find_grams(blocks: Blocks, width: int, counts: Counts) -> None:
    """Ask which grams occur elsewhere and, for heavy ones, which whole windows do."""

    def grams(block: Block) -> Iterator[tuple[int, bytes]]:
        known, kinds, sign = _Suffixes(block, width, counts).grams()
        for bucket, a, b in split_sorted(known, counts.grams):
            yield bucket, flat(kinds[a:b], sign[a:b], *pack_keys(known[a:b]))

    def split(block: Block) -> bool:
        return any(unpack(a)[1].any() for a in block.answers.get("grams", {}).values())

    def windows(block: Block) -> Iterator[tuple[int, bytes]]:
        known = _Suffixes(block, width, counts).window_keys() if split(block) else np.zeros(0, np.uint64)
        for bucket, a, b in split_sorted(known, counts.windows):
            yield bucket, flat(*pack_keys(known[a:b]))

    blocks.ask("grams", grams, lambda payloads: seen_grams(payloads, counts.heavy))
    blocks.ask("windows", windows, seen_twice)


def sort_suffixes(payloads: list[bytes], width: int) -> list[bytes | None]:
    """For each message of contexts, the bits of the suffixes whose window stands earlier.

    All distinct contexts form one text in the order of (document, place), whose
    suffixes are sorted bucket by bucket; equal contexts need no place of their own there.
    """
    parts = [unpack(p) for p in payloads]
    keys, docs, inside, sizes, data = (np.concatenate([p[k] for p in parts]) for k in range(5))
    sizes = sizes.astype(np.int64)
    ends = np.cumsum(sizes + width - 1)
    starts = ends - sizes - width + 1
    order = np.lexsort([inside, docs])
    equal = first_equal(data, starts[order], ends[order], keys[order])
    fresh = order[equal == np.arange(len(order))]
    lengths = sizes[fresh] + width - 1
    text = gather(data, starts[fresh], lengths)
    del data
    places = np.cumsum(lengths) - lengths
    bits = np.ones(int(sizes.sum()), dtype=bool)
    first_bit = np.cumsum(sizes) - sizes
    bits[ranges(first_bit[fresh], sizes[fresh])] = repeated_later(text, ranges(places, sizes[fresh]), width)
    out, at = [], 0
    for p in parts:
        own = bits[at : at + int(p[3].sum())]
        out.append(pack(np.packbits(own)) if own.any() else None)
        at += len(own)
    return out


def drop_repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 100, heavy: int = HEAVY) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, removed_from, removed_to, kept (binary).

    Each byte is removed that is covered by a string of ``width`` bytes (40 at least) which also starts
    earlier: in a document of smaller id, or before in the same one. Strings are
    judged on the input and never cross documents. The spans are maximal runs of removed
    bytes, ends exclusive; kept is all other bytes, which need not be valid UTF-8.

    Suffixes are dealt to buckets by the least 32-byte gram of their window. Grams that
    occur once end there, and one in ``heavy`` different contexts or more, about, is split by whole windows. The contexts of the others meet by bucket, equal ones joined
    first within their block, and each range of buckets is sorted blockwise: 8 bytes
    first, long ties by ranks of a difference-cover sample (``suffix``); neighbours in that order are compared
    byte by byte. Memory is that of one range's distinct contexts.

    A null text is empty; texts shorter than ``width`` keep everything. Ids are integers; a null id comes
    before all others. Of rows with one id, places decide, and between equal places both are kept or removed by the
    order in which they are read. An empty table gives no rows; other columns are ignored.
    """
    blocks = Blocks(docs, id_col, text_col, "suffix_dedup")
    counts = Counts(blocks.ranges(64 << 20), blocks.ranges(64 << 20), blocks.ranges(4 << 20), heavy)

    def result(block: Block) -> Iterator[pa.RecordBatch]:
        gone = _Suffixes(block, width, counts).removed()
        first, last = runs(gone)
        inner = block.offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(gone))]
        cut = np.unique(inner[gone[inner] & gone[inner - 1]]) if len(inner) else inner
        first, last = np.sort(np.concatenate([first, cut])), np.sort(np.concatenate([last, cut]))
        spans = span_columns(first, last, block.offsets)
        total = np.diff(block.offsets)
        left = block.data[~gone].tobytes()
        edge = np.concatenate([[0], np.cumsum(~gone, dtype=np.int32 if len(gone) < 2**31 else np.int64)])[block.offsets].astype(np.int64)
        kept = [left[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
        columns = [pa.array(block.ids), pa.array(total), pa.array(total - np.diff(edge)), *spans, pa.array(kept, pa.binary())]
        for at in range(0, len(total), 1000):
            yield pa.RecordBatch.from_arrays([c.slice(at, 1000) for c in columns], names=["id", "n_bytes", "n_removed", "removed_from", "removed_to", "kept"])

    find_grams(blocks, width, counts)
    blocks.ask("suffixes", lambda block: _Suffixes(block, width, counts).contexts(), lambda payloads: sort_suffixes(payloads, width))
    out = blocks.map(result, "id long, n_bytes long, n_removed long, removed_from array<long>, removed_to array<long>, kept binary")
    return out.withColumn("id", F.when(F.col("id") != NULL_ID, F.col("id"))).withColumnRenamed("id", id_col)
