"""Documents in staged blocks, and questions that blocks answer for one another.

Operators that look for content shared between documents need every document
several times, but only little of it has to meet other documents'. So the texts are
staged once as blocks of several MB (a table bucketed by block number, compressed), and
each pass reads them in place. A pass sends short packed messages, dealt by
hash range; what a range finds out is sent back as small answers that are
joined to the blocks by their bucketing, so texts are never shuffled.

A key is sent at most once by each block, however often the block has it, so
a key that a third of all documents share is no larger than any other.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.staging import Stage
from strata.llm.text import utf8

#: Bytes of text in a block: a 256th of the input between these bounds (a longer document is a block of its own).
BLOCK, LARGE_BLOCK = 2 << 20, 8 << 20
#: Bytes of messages that a task gathers over its blocks before it sends one bundle to each range.
BUNDLE = 32 << 20
_MESSAGE = "bucket int, payload binary"
_ANSWER = "block_id long, bucket int, payload binary, totals array<long>"


#: Kinds of array that messages hold.
_KINDS = [np.dtype(k) for k in ("<u8", "<i8", "<u4", "<i4", "u1", "?")]


def flat(*arrays: np.ndarray) -> bytes:
    """Arrays in one buffer; unpack() gives them back. Each has 8 bytes of header and starts at a multiple of 8."""
    out = []
    for a in arrays:
        raw = np.ascontiguousarray(a).tobytes()
        out += [struct.pack("<II", _KINDS.index(a.dtype), a.size), raw, b"\0" * (-len(raw) % 8)]
    return b"".join(out)


def pack(*arrays: np.ndarray) -> bytes:
    """As flat(), compressed where that may pay."""
    raw = flat(*arrays)
    return zstandard.ZstdCompressor(level=1).compress(raw) if len(raw) > 64 else raw


def unpack(data: bytes | memoryview) -> list[np.ndarray]:
    if data[:4] == zstandard.FRAME_HEADER:
        data = zstandard.ZstdDecompressor().decompress(data)
    at, out = 0, []
    while at < len(data):
        kind, size = struct.unpack_from("<II", data, at)
        out.append(np.frombuffer(data, _KINDS[kind], size, at + 8))
        at += 8 + -(-size * _KINDS[kind].itemsize // 8) * 8
    return out


def bundle(numbers: list[int], payloads: list[bytes]) -> bytes:
    """Messages of several blocks to one range as one, compressed together."""
    sizes = np.array([len(p) for p in payloads], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([struct.pack("<Q", len(sizes)), np.array(numbers, "<i8").tobytes(), sizes.tobytes(), *payloads]))


def unbundle(bundles: list[bytes]) -> tuple[np.ndarray, list[memoryview]]:
    """Block numbers, ascending, and their messages."""
    numbers, payloads = [np.zeros(0, np.int64)], []
    for b in bundles:
        raw = zstandard.ZstdDecompressor().decompress(b)
        (n,) = struct.unpack_from("<Q", raw)
        numbers.append(np.frombuffer(raw, "<i8", n, 8))
        at = 8 + 16 * n + np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<i8", n, 8 + 8 * n))])
        view = memoryview(raw)
        payloads += [view[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    number = np.concatenate(numbers)
    order = np.argsort(number, kind="stable")
    return number[order], [payloads[i] for i in order.tolist()]


class Block:
    """Documents of one block: number, ids, concatenated bytes, offsets, the answers it got, by name and range, and the other columns."""

    def __init__(self, number: int, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, answers: dict[str, dict[int, bytes]], rest: bytes | None):
        self.number, self.ids, self.data, self.offsets, self.answers, self.rest = number, ids, data, offsets, answers, rest


def _shut(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_batches(batches).combine_chunks()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _cut(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    base, count = TaskContext.get().partitionId() << 32, 0

    def made(ids: list[np.ndarray], texts: list[np.ndarray], lengths: list[np.ndarray], rest: list[pa.RecordBatch]) -> pa.RecordBatch:
        nonlocal count
        data = zstandard.ZstdCompressor(level=1).compress(np.concatenate(texts).tobytes())
        count += 1
        columns = [pa.array([base + count - 1], pa.int64()), pa.array([np.concatenate(ids).astype("<i8").tobytes()]), pa.array([np.concatenate(lengths).astype("<i8").tobytes()]), pa.array([data]), pa.array([_shut(rest) if rest[0].num_columns else None], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["block_id", "ids", "lengths", "data", "rest"])

    ids, texts, lengths, rest, held = [], [], [], [], 0
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        number = batch.column(0).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(number):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size - held, side="right")) - 1)
            ids.append(number[at:to].copy())
            texts.append(data[offsets[at] : offsets[to]].copy())
            lengths.append(np.diff(offsets[at : to + 1]))
            rest.append(batch.select(range(2, batch.num_columns)).slice(at, to - at))
            held += int(offsets[to] - offsets[at])
            at = to
            if held >= size or at < len(number):
                yield made(ids, texts, lengths, rest)
                ids, texts, lengths, rest, held = [], [], [], [], 0
    if ids:
        yield made(ids, texts, lengths, rest)


def _open(batch: pa.RecordBatch) -> Iterator[Block]:
    columns = batch.to_pydict()
    for i in range(batch.num_rows):
        ids = np.frombuffer(columns["ids"][i], dtype="<i8")
        offsets = np.concatenate([[0], np.cumsum(np.frombuffer(columns["lengths"][i], dtype="<i8"))])
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(columns["data"][i]), dtype=np.uint8)
        answers: dict[str, dict[int, bytes]] = {}
        for name in columns:
            if name.startswith("answer_"):
                answers[name[7:]] = {a["bucket"]: a["payload"] for a in columns[name][i] or []}
        yield Block(columns["block_id"][i], ids, data, offsets, answers, columns["rest"][i])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield from _open(batch.slice(i, 1))


#: Stands for a null id inside blocks: before all others.
NULL_ID = -(2**63)


class Blocks:
    """Staged documents with integer ids; a null id comes before all others, a null text is empty."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, name: str, carry: bool = False):
        self.docs, self.text_col = docs, text_col
        self.stage = Stage(docs.sparkSession, name)
        rest = [F.col(text_col).isNull() if c == text_col else docs[c] for c in docs.columns] if carry else []
        rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"), *(c.alias(f"c{k}") for k, c in enumerate(rest)))
        self.bytes, self.rows = rows.agg(F.coalesce(F.sum(F.octet_length("t").cast("long")), F.lit(0)), F.count(F.lit(1))).first()
        size = int(min(max(BLOCK, self.bytes / 256), LARGE_BLOCK))
        # With fewer buckets than shuffle partitions Spark would move the blocks to the answers, not the answers to them.
        partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        buckets = int(max(24, min(self.bytes / (4 * size), 1 << 16), partitions))
        cut = rows.mapInArrow(lambda batches: _cut(batches, size), "block_id long, ids binary, lengths binary, data binary, rest binary")
        self.table = self.stage.table(cut, "blocks", buckets, "block_id")
        self.answers: dict[str, DataFrame] = {}

    def ranges(self, bytes_each: float) -> int:
        """How many hash ranges there are when one's messages come from about bytes_each bytes of text; 64 at least."""
        return int(max(64, self.bytes / bytes_each))

    def _joined(self) -> DataFrame:
        out = self.table
        for name, rows in self.answers.items():
            packed = rows.groupBy("block_id").agg(F.collect_list(F.struct("bucket", "payload")).alias(f"answer_{name}"))
            out = out.join(packed.hint("shuffle_hash"), "block_id", "left")
        return out

    def map(self, each: Callable[[Block], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """What each block gives, with the answers so far."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in _blocks(batches):
                yield from each(block)
                pa.default_memory_pool().release_unused()

        return self._joined().mapInArrow(run, schema)

    def messages(self, send: Callable[[Block], Iterator[tuple[int, bytes]]]) -> DataFrame:
        """bucket and payload: bundles of the (range, message) that blocks send.

        A task bundles its blocks' messages by range, so a message costs its
        bytes and not a row, however many blocks and ranges there are.
        """

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
            size = 0

            def sent() -> Iterator[pa.RecordBatch]:
                ready = sorted(held)
                for at in range(0, len(ready), 64):
                    some = ready[at : at + 64]
                    packed = [bundle(*map(list, zip(*held.pop(r), strict=True))) for r in some]
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "payload"])

            for block in _blocks(batches):
                for bucket, payload in send(block):
                    held[bucket].append((block.number, payload))
                    size += len(payload) + 64
                if size > BUNDLE:
                    yield from sent()
                    size = 0
                pa.default_memory_pool().release_unused()
            yield from sent()

        return self._joined().mapInArrow(run, _MESSAGE)

    def ask(self, name: str, send: Callable[[Block], Iterator[tuple[int, bytes]]], decide: Callable[..., list[bytes | None]], totals: Callable[[list[bytes]], list[int]] | None = None, beside: DataFrame | None = None) -> DataFrame:
        """Send (range, message) from each block; decide on all of one range and answer each, or not.

        ``totals`` of a range's messages, if asked for, stand in the first of its answers.
        ``beside`` has rows (bucket, payload); decide is then given the payloads of its range too.
        """

        def decided(group: pa.Table, *held: list[bytes]) -> pa.Table:
            numbers, messages = unbundle(group["payload"].to_pylist())
            answers = decide(messages, *held) if messages else []
            pa.default_memory_pool().release_unused()
            keep = [i for i, a in enumerate(answers) if a is not None]
            once = [None] * len(keep)
            if totals and keep:
                once[0] = totals(messages)
            bucket = group["bucket"][0].as_py() if len(keep) else 0
            return pa.table({"block_id": numbers[keep].astype(np.int64), "bucket": pa.array([bucket] * len(keep), pa.int32()), "payload": pa.array([answers[i] for i in keep], pa.binary()), "totals": pa.array(once, pa.list_(pa.int64()))})

        found = self.messages(send).groupBy("bucket")
        if beside is None:
            found = found.applyInArrow(lambda group: decided(group), _ANSWER)
        else:
            found = found.cogroup(beside.groupBy("bucket")).applyInArrow(lambda group, own: decided(group, own["payload"].to_pylist()), _ANSWER)
        self.answers[name] = self.stage.put(found, name)
        return self.answers[name]

    def without(self, dropped: DataFrame) -> DataFrame:
        """The documents with all their columns, as staged with carry, but for the rows (block_id, row) dropped."""
        place = self.docs.columns.index(self.text_col)
        names, kinds = self.docs.columns, [f.dataType.simpleString() for f in self.docs.schema]

        def told(group: pa.Table) -> pa.Table:
            data = pack(group["row"].to_numpy())
            return pa.table({"block_id": group["block_id"].slice(0, 1), "bucket": pa.array([0], pa.int32()), "payload": pa.array([data], pa.binary()), "totals": pa.array([None], pa.list_(pa.int64()))})

        def kept(block: Block) -> Iterator[pa.RecordBatch]:
            table = pa.ipc.open_stream(block.rest).read_all()
            stay = np.ones(len(block.ids), dtype=bool)
            if 0 in block.answers.get("dropped", {}):
                stay[unpack(block.answers["dropped"][0])[0]] = False
            absent = table.column(place).to_numpy()
            raw = block.data.tobytes()
            texts = [None if n else raw[a:b] for a, b, n in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), absent.tolist(), strict=True)]
            table = table.set_column(place, f"c{place}", pa.array(texts, pa.binary()).cast(pa.string())).filter(pa.array(stay)).rename_columns([f"c{k}" for k in range(len(names))])
            yield from table.combine_chunks().to_batches(1000)

        kept_before = self.answers
        self.answers = {"dropped": self.stage.put(dropped.select("block_id", "row").groupBy("block_id").applyInArrow(told, _ANSWER), "dropped")}
        out = self.map(kept, ", ".join(f"c{k} {kind}" for k, kind in enumerate(kinds)))
        self.stage.drop(*kept_before)
        return out.toDF(*names)

    def finish(self, result: DataFrame, *names: str) -> DataFrame:
        """A small result, staged; the blocks, all answers and the tables of these names are removed."""
        out = self.stage.put(result, "result")
        self.stage.drop(*self.answers, *names)
        self.stage.drop()
        return out


def split_sorted(keys: np.ndarray, ranges: int) -> Iterator[tuple[int, int, int]]:
    """(range, first, end) of the sorted 64-bit keys in each of equal ranges of their values; empty ones are left out."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(keys) else np.zeros(1, int)
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield int(bucket[a]), int(a), int(b)


def pack_keys(keys: np.ndarray, bits: int = 48) -> list[np.ndarray]:
    """Sorted distinct keys, cut to their upper bits, as gaps of 32 bits where they fit."""
    short = keys >> np.uint64(64 - bits)
    gaps = np.diff(short, prepend=np.uint64(0))
    if len(gaps) > 1 and gaps[1:].max() >= 2**32:
        return [short]
    return [gaps[:1], gaps[1:].astype(np.uint32)]


def unpack_keys(parts: list[np.ndarray]) -> np.ndarray:
    return parts[0] if len(parts) == 1 else np.cumsum(np.concatenate([parts[0], parts[1].astype(np.uint64)]), dtype=np.uint64)


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    ranked = np.sort(keys)
    return ranked[np.concatenate([[True], ranked[1:] != ranked[:-1]])] if len(ranked) else ranked


def seen_twice(payloads: list[bytes]) -> list[bytes | None]:
    """For each message of sorted distinct keys, the bits of those that another message has too; None if there are none."""
    keys = [unpack_keys(unpack(p)) for p in payloads]
    ranked = np.sort(np.concatenate(keys))
    shared = distinct(ranked[1:][ranked[1:] == ranked[:-1]])
    if not len(shared):
        return [None] * len(keys)
    out: list[bytes | None] = []
    for k in keys:
        hit = shared[np.minimum(np.searchsorted(shared, k), len(shared) - 1)] == k
        out.append(pack(np.packbits(hit)) if hit.any() else None)
    return out


def shared_keys(keys: np.ndarray, answers: dict[int, bytes], ranges: int) -> np.ndarray:
    """The mask over sorted distinct keys that the answers to their messages give."""
    out = np.zeros(len(keys), dtype=bool)
    for bucket, a, b in split_sorted(keys, ranges):
        if bucket in answers:
            out[a:b] = np.unpackbits(unpack(answers[bucket])[0], count=b - a).astype(bool)
    return out


def grouped(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the least doc of each, whether it has several docs, and each item's place among them."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, bool)
    heads = np.flatnonzero(first)
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(first) - 1
    if not len(heads):
        return ranked, docs[:0], np.zeros(0, bool), place
    least, most = np.minimum.reduceat(docs[order], heads), np.maximum.reduceat(docs[order], heads)
    return ranked[heads], least, least != most, place


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


def span_columns(first: np.ndarray, end: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Spans over the concatenated items as lists per text, counted from the text's start; a span is inside one text."""
    owner = np.searchsorted(offsets, first, side="right") - 1
    counts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(offsets) - 1))]).astype(np.int32)
    base = offsets[owner]
    return tuple(pa.ListArray.from_arrays(pa.array(counts), pa.array((x - base).astype(np.int64))) for x in (first, end))
