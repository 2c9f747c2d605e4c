"""Packing of tokenised documents into sequences by first-fit decreasing over a tournament tree."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.text import WORD, by_bytes, ranges, slice_hashes, utf8, word_spans

#: Words whose ids a worker remembers, about 40 bytes each.
REMEMBERED = 1_500_000
PIECES = "deal int, doc_id {id}, start long, length long, ids binary, doc_tokens long"


class WordTokenizer:
    """Ids of texts by a tokenizer whose pieces never cross white space.

    Each different word is encoded once, as long as it is remembered: their
    hashes, ascending, and their ids end to end. New words are encoded many at a time,
    with one of the tokenizer's own special tokens between them, which ends a word as white space does.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        for text in ("a b", " a b", "a  b", "a\tb\n", "Ab, cd.  e", "\u00a0a b"):
            whole = self.tokenizer.encode(text, add_special_tokens=False).ids
            if whole != [i for w in re.findall(WORD, text) for i in self.tokenizer.encode(w, add_special_tokens=False).ids]:
                raise ValueError(f"this tokenizer's ids of a word depend on the white space around it: {text!r}")
        plain = [t for t in json.loads(definition).get("added_tokens", []) if t["special"] and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"])]
        self.mark, self.mark_id = (plain[-1]["content"], plain[-1]["id"]) if plain else (None, None)
        self._forget()

    def _forget(self) -> None:
        self.keys, self.first, self.flat = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids end to end, and how many each has."""
        out, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), 256):
            some = words[at : at + 256]
            text = self.mark.join(some) if self.mark else ""
            if self.mark and text.count(self.mark) == len(some) - 1:
                ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
                between = ids == self.mark_id
                sizes.append(np.diff(np.flatnonzero(np.concatenate([[True], between, [True]]))) - 1)
                out.append(ids[~between])
            else:
                found = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
                sizes.append(np.array([len(f) for f in found], np.int64))
                out += [np.array(f, dtype=np.uint32) for f in found]
        return np.concatenate(out), np.concatenate(sizes)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Add ascending new keys."""
        fresh, sizes = self._encoded(words)
        keys_, sizes_ = np.concatenate([self.keys, keys]), np.concatenate([np.diff(self.first), sizes])
        begin = np.concatenate([self.first[:-1], len(self.flat) + np.cumsum(sizes) - sizes])
        flat = np.concatenate([self.flat, fresh])
        order = np.argsort(keys_, kind="stable")
        self.keys, sizes_ = keys_[order], sizes_[order]
        self.flat = flat[ranges(begin[order], sizes_)]
        self.first = np.concatenate([[0], np.cumsum(sizes_)])

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, each text's followed by end_id, and the texts' offsets into them."""
        data, offsets = utf8(column)
        starts, ends, words = word_spans(data, offsets)
        hashes = slice_hashes(data, starts, ends)
        order = np.argsort(hashes)
        ranked = hashes[order]
        head = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, int)
        place = np.empty(len(order), np.int64)
        place[order] = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(order))))
        kinds, sample = ranked[head], order[head]
        if len(self.keys) + len(kinds) > REMEMBERED:
            self._forget()
        at = np.minimum(np.searchsorted(self.keys, kinds), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[at] != kinds) if len(self.keys) else np.arange(len(kinds))
        if len(new):
            raw = data.tobytes()
            self._learn(kinds[new], [raw[a:b].decode() for a, b in zip(starts[sample[new]].tolist(), ends[sample[new]].tolist(), strict=True)])
        at = np.searchsorted(self.keys, kinds)[place]
        lengths = self.first[at + 1] - self.first[at] if len(at) else np.zeros(0, np.int64)
        bounds = np.concatenate([[0], np.cumsum(lengths)])[words] + np.arange(len(words))
        out = np.full(int(bounds[-1]), end_id, np.uint32)
        inside = np.ones(len(out), dtype=bool)
        inside[bounds[1:] - 1] = False
        out[inside] = self.flat[ranges(self.first[at] if len(at) else at, lengths)]
        return out, bounds


#: A worker's tokenizer lives on from task to task.
_OWN: dict[str, WordTokenizer] = {}


def own_tokenizer(definition: str) -> WordTokenizer:
    if definition not in _OWN:
        _OWN.clear()
        _OWN[definition] = WordTokenizer(definition)
    return _OWN[definition]


class Bins:
    """Bins of equal capacity; a tournament tree over the room left finds the first bin that fits."""

    def __init__(self, most: int, capacity: int):
        self.leaves = 1 << max(0, (most - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first bin with room for size, which is taken."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bin_ = node - self.leaves
        room[node] -= size
        while node > 1:
            node //= 2
            left, right = room[2 * node], room[2 * node + 1]
            room[node] = left if left > right else right
        return bin_


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item of at most ``capacity``, taken from the largest to the smallest."""
    out = np.zeros(len(sizes), np.int64)
    bins = Bins(max(1, len(sizes)), capacity)
    for item in np.argsort(-sizes, kind="stable").tolist():
        out[item] = bins.place(int(sizes[item]))
    return out


def lay_out(sizes: np.ndarray, capacity: int, loose: int) -> list[tuple[int, int, int, int, int]]:
    """(item, first, length, sequence, offset) for pieces that cover all items.

    Bins with at most ``loose`` free places are sequences as they are. The
    items of the others are put end to end and cut: into full sequences and, for what is left, sequences of falling powers
    of two, which need no padding.
    """
    bins = first_fit_decreasing(sizes, capacity)
    held = np.bincount(bins, sizes, minlength=0).astype(np.int64)
    order = np.argsort(bins, kind="stable")
    out: list[tuple[int, int, int, int, int]] = []
    rest: list[int] = []
    sequence, last, offset = -1, -1, 0
    for item in order.tolist():
        bin_, size = int(bins[item]), int(sizes[item])
        if capacity - held[bin_] > loose and held[bin_] & (held[bin_] - 1):
            rest.append(item)
            continue
        if bin_ != last:
            sequence, last, offset = sequence + 1, bin_, 0
        out.append((item, 0, size, sequence, offset))
        offset += size
    left = int(sum(sizes[i] for i in rest))
    room = offset = 0
    for item in rest:
        at, size = 0, int(sizes[item])
        while at < size:
            if offset == room:
                room = capacity if left >= capacity else 1 << (left.bit_length() - 1)
                sequence, offset, left = sequence + 1, 0, left - room
            take = min(size - at, room - offset)
            out.append((item, at, take, sequence, offset))
            at, offset = at + take, offset + take
    return out


def pieces(tokenizer: WordTokenizer, batch: pa.RecordBatch, end_id: int, longest: int) -> pa.RecordBatch:
    """The pieces of a batch of deal, id and text."""
    ids, bounds = tokenizer.encode(batch.column(2), end_id)
    total = np.diff(bounds)
    count = -(-total // longest)
    doc = np.repeat(np.arange(len(total)), count)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * longest
    length = np.minimum(total[doc] - start, longest)
    at = (bounds[:-1][doc] + start).tolist()
    raw = [ids[a : a + n].tobytes() for a, n in zip(at, length.tolist(), strict=True)]
    columns = [batch.column(0).take(pa.array(doc)), batch.column(1).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(raw, pa.binary()), pa.array(total[doc])]
    return pa.RecordBatch.from_arrays(columns, names=["deal", "doc_id", "start", "length", "ids", "doc_tokens"])


def packed(group: pa.Table, deal: int, capacity: int, loose: int) -> pa.Table:
    """A group's pieces in their sequences, which are numbered from ``deal`` times 2^32 on."""
    ids, start = group["ids"].to_pylist(), group["start"].to_numpy()
    rows = lay_out(group["length"].to_numpy(), capacity, loose)
    item, first, length, sequence, offset = (np.array([r[k] for r in rows], np.int64) for k in range(5))
    take = pa.array(item)
    return pa.table({
        "deal": group["deal"].take(take),
        "doc_id": group["doc_id"].take(take),
        "start": start[item] + first,
        "length": length,
        "ids": pa.array([ids[i][4 * a : 4 * (a + n)] for i, a, n, _, _ in rows], pa.binary()),
        "doc_tokens": group["doc_tokens"].take(take),
        "sequence_id": (deal << 32) + sequence,
        "offset": offset,
    })


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int, longest: int, groups: int, seed: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``longest`` ids of each document: deal, doc_id, start, length, ids (little-endian, 32 bits), doc_tokens.

    ``deal`` is the group that the hash of the document's id and text gives it.
    """
    definition = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = own_tokenizer(definition.value)
        for batch in by_bytes(batches, 2, 4 << 20):
            yield pieces(tokenizer, batch, end_id, longest)

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    deal = F.pmod(F.xxhash64(F.col(id_col).cast("string"), text, F.lit(seed)), F.lit(groups)).cast("int")
    return docs.select(deal.alias("deal"), F.col(id_col).alias("doc_id"), text.alias("t")).mapInArrow(run, PIECES.format(id=kind))


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 2,
    capacity: int = 4096,
    loose: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_bytes: int = 16 << 20,
    seed: int = 17,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    A document is its ids (without special tokens) and ``end_id``. It is cut after every
    ``capacity`` ids; documents are dealt by hash to groups of about ``group_bytes`` of text, and each group's pieces are packed on their own by
    first-fit decreasing. Sequences with more than ``loose`` free places are cut
    again (see ``lay_out``), so each group pads ``loose`` places a sequence at most. ``ids`` are
    little-endian 32-bit numbers; ``offset`` is the piece's place in its sequence, from 0 and without gaps.

    A null text is empty: a document of just ``end_id``. A null id is kept as it is. Repeated rows
    are packed one by one, which repeats (doc_id, start). An empty table gives no rows; other columns are ignored.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col).cast("long")), F.lit(0))).first()[0]
    groups = int(max(min(64, -(-size // (1 << 20))), -(-size // group_bytes), 1))
    dealt = tokenize(docs, tokenizer_path, end_id, capacity, groups, seed, id_col, text_col)

    def pack(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        return packed(group.sort_by([("doc_id", "ascending"), ("start", "ascending")]), key[0].as_py(), capacity, loose)

    kind = docs.schema[id_col].dataType.simpleString()
    out = dealt.groupBy("deal").applyInArrow(pack, PIECES.format(id=kind) + ", sequence_id long, offset long")
    return out.drop("deal").withColumnRenamed("doc_id", id_col)


def pack_in_order(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 2,
    capacity: int = 4096,
    loose: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_bytes: int = 16 << 20,
) -> DataFrame:
    """As ``pack_documents``, of documents in an order that counts: a mixture's.

    The order is that of the files' names and their rows, or of partitions and their rows where there are no files. A group is a
    stretch of about ``group_bytes`` of it, so its sequences hold documents that come near each other, and groups
    are numbered in order. Every document counts 16 bytes beside its text.
    """
    definition = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text())
    text = F.col(text_col).cast("string")
    try:
        file = docs.select("_metadata.file_name") and F.col("_metadata.file_name")
    except AnalysisException:  # not read from files
        file = F.lit("")
    rows = docs.select(file.alias("file"), F.monotonically_increasing_id().alias("at"), F.col(id_col).alias("doc_id"), text.alias("t"))
    bytes_ = F.sum(F.coalesce(F.octet_length("t"), F.lit(0)).cast("long") + 16)
    parts = rows.groupBy("file", F.shiftrightunsigned("at", 33).alias("part")).agg(bytes_.alias("bytes"))
    # One row for each file's piece that a task reads.
    before = F.sum("bytes").over(Window.orderBy("file", "part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("file", "part", F.coalesce(before, F.lit(0)).alias("before"), F.sum("bytes").over(Window.partitionBy()).alias("total"))
    # As many groups as pack_documents makes.
    groups = f"greatest(least(64, ceil(total / {1 << 20})), ceil(total / {group_bytes}), 1)"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = own_tokenizer(definition.value)
        last, done = None, 0
        for batch in by_bytes(batches, 3, 4 << 20):
            files = batch.column(0).to_pylist()
            sizes = (np.diff(utf8(batch.column(3))[1]) + 16).tolist()
            run_ = []
            for file, size in zip(files, sizes, strict=True):
                last, done = file, (done if file == last else 0) + size
                run_.append(done - size)
            own = pieces(tokenizer, pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows, dtype=np.int32)), batch.column(2), batch.column(3)], names=["deal", "doc_id", "t"]), end_id, capacity)
            row = own.column(0)
            told = [batch.column(0).take(row), batch.column(1).take(row), pa.array(run_, pa.int64()).take(row), *own.columns[1:]]
            yield pa.RecordBatch.from_arrays(told, names=["file", "at", "run", *own.schema.names[1:]])

    def pack(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        return packed(group.sort_by([("file", "ascending"), ("at", "ascending"), ("start", "ascending")]), key[0].as_py(), capacity, loose)

    kind = docs.schema[id_col].dataType.simpleString()
    held = PIECES.format(id=kind).replace("deal int", "file string, at long, run long")
    found = rows.mapInArrow(run, held).withColumn("part", F.shiftrightunsigned("at", 33)).join(parts, ["file", "part"], "left")
    deal = F.coalesce(F.expr(f"(before + run) div ceil(total / {groups})"), F.lit(0)).cast("int")
    out = found.withColumn("deal", deal).select("deal", "doc_id", "start", "length", "ids", "doc_tokens", "file", "at")
    out = out.groupBy("deal").applyInArrow(pack, PIECES.format(id=kind) + ", sequence_id long, offset long")
    return out.drop("deal").withColumnRenamed("doc_id", id_col)
