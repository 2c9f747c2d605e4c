"""Language-model scores of texts, with n-gram counts in a log-frequency Bloom filter."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.blocks import NULL_ID, Block, Blocks, distinct, flat, pack, split_sorted, unbundle, unpack
from strata.llm.count_filter import CountFilter, build_segment, level_of, twice_count_of
from strata.llm.text import lower, mix, slice_hashes, unmix, word_spans

_END = np.uint64(0x5851F42D4C957F2D)
_HALF = np.uint64(32)


class _Tokens:
    """Hashes of the block's lower-cased words and one end per document, as tokens in a row."""

    def __init__(self, block: Block, parts: int, held_part: int):
        data = lower(block.data)
        starts, ends, words = word_spans(data, block.offsets)
        self.offsets = words + np.arange(len(words))
        self.keys = np.full(int(self.offsets[-1]), _END, np.uint64)
        inside = np.ones(len(self.keys), dtype=bool)
        inside[self.offsets[1:] - 1] = False
        self.keys[inside] = slice_hashes(data, starts, ends)
        part = np.array([zlib.crc32(b"" if i == NULL_ID else str(i).encode()) % parts for i in block.ids.tolist()], dtype=np.int64)
        self.held_out = part == held_part
        self.train = np.repeat(~self.held_out, np.diff(self.offsets))
        # The token before each one; before a text's first stands an end.
        self.before = np.concatenate([[_END], self.keys[:-1]]) if len(self.keys) else self.keys

    def pairs(self) -> np.ndarray:
        """Keys of (token before, token): the upper halves of both hashes, mixed. history_of() gives the first back."""
        return mix((self.before >> _HALF << _HALF) | (self.keys >> _HALF))


def history_of(pairs: np.ndarray) -> np.ndarray:
    """The upper half of the hash of each pair's first token."""
    return unmix(pairs) >> _HALF


def _counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each is in training."""
    known = distinct(keys)
    return known, np.bincount(np.searchsorted(known, keys[train]), minlength=len(known))


def _grouped_sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys and the sum of each of the values by key."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    heads = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
    return ranked[heads], *(np.add.reduceat(v[order], heads) if len(heads) else v[:0] for v in values)


def _summed(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sorted distinct keys of all messages, their total counts, and each message's keys."""
    parts = [unpack(p) for p in payloads]
    known, counts = _grouped_sums(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64))
    return known, counts, [p[0] for p in parts]


def _narrow(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.uint32 if counts.max(initial=0) < 2**32 else np.int64)


def _totals(payloads: list[bytes], follows: list[bytes]) -> list[bytes | None]:
    """For each message of words: their counts, and what follows them: twice the held counts, and the number of different tokens."""
    known, counts, own = _summed(payloads)
    stats = [unpack(f) for f in follows]
    half, twice, kinds = _grouped_sums(*(np.concatenate([s[k] for s in stats]) if stats else np.zeros(0, np.uint64 if k == 0 else np.int64) for k in range(3)))
    at = np.minimum(np.searchsorted(half, known >> _HALF), max(0, len(half) - 1))
    found = half[at] == known >> _HALF if len(half) else np.zeros(len(known), bool)
    twice, kinds = (np.where(found, v[at], 0) if len(half) else np.zeros(len(known), np.int64) for v in (twice, kinds))
    places = [np.searchsorted(known, k) for k in own]
    return [pack(*(_narrow(v[at]) for v in (counts, twice, kinds))) for at in places]


def _answered(keys: np.ndarray, answers: dict[int, bytes], count: int, columns: int = 1) -> list[np.ndarray]:
    """The numbers that the answers give for sorted distinct keys."""
    out = [np.zeros(len(keys), np.int64) for _ in range(columns)]
    for bucket, a, b in split_sorted(keys, count):
        if bucket in answers:
            for own, found in zip(out, unpack(answers[bucket]), strict=True):
                own[a:b] = found
    return out


def score_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    parts: int = 10,
    held_part: int = 0,
    least: int = 1,
    bits_each: int = 12,
    probes: int = 6,
    most_filter_bytes: int = 64 << 20,
) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the lower-cased words and one end. Learned from documents for which
    crc32 of the id as text modulo ``parts`` isn't ``held_part``. base_score is the
    unigram score with 0.1 added to each count, from exact counts (blocks ask
    for their distinct words).

    score is the text's log10 probability by the pair model: with c(h, w) the count of token w after h as the
    filter gives it, and C and T the sum and the number of the counts held after h, P(w | h) = (c(h, w) + T * P(w)) / (C + T),
    P(w) being the unigram probability (Witten and Bell's smoothing). It sums to 1 over the training tokens and one unknown token,
    but for the filter's false positives.
    Pair counts come from a log-frequency Bloom filter that holds all pairs seen ``least`` times or more, by doubling
    levels (a count is the middle of its level; level 1 of least 1 is 1), at ``bits_each`` bits a level; C and T are exact sums over what was put in. The filter is built in
    hash ranges. If the input's size proves that it has at most ``most_filter_bytes`` it is broadcast and probed in the blocks; else each range's segment is probed where it
    is built, for the pairs that the blocks sent there: the same bits, levels and scores.

    A null or empty text is one end. A null id has crc32 of ''; ids are integers. Repeated rows
    are counted and scored one by one; an empty table gives no rows; other columns are ignored.
    """
    blocks = Blocks(docs, id_col, text_col, "lm_scoring")
    spark = docs.sparkSession
    count = blocks.ranges(12 << 20)

    # A pair seen c times has at most c levels and there are no more pairs than tokens: a bound of the filter's size.
    small = bits_each * (blocks.bytes / 2 + 2 * blocks.rows) / 8 <= most_filter_bytes

    def pairs(block: Block) -> Iterator[tuple[int, bytes]]:
        tokens = _Tokens(block, parts, held_part)
        own, train = tokens.pairs(), tokens.train
        known, seen = _counted(own[train], train[train]) if small else _counted(own, train)
        for bucket, a, b in split_sorted(known, count):
            yield bucket, flat(known[a:b], _narrow(seen[a:b]))

    def segment(group: pa.Table) -> pa.Table:
        """The range's bits ('bits'), what follows the histories, for their words' ranges ('follows'), or in place of the bits each block's levels ('levels')."""
        me = group["bucket"][0].as_py()
        numbers, messages = unbundle(group["payload"].to_pylist())
        known, counts, own = _summed(messages)
        levels = level_of(counts, least)
        held = levels > 0
        bits = build_segment(known[held], levels[held], bits_each, probes) if held.any() else np.zeros(0, np.uint8)
        half, twice, kinds = _grouped_sums(history_of(known[held]), twice_count_of(levels[held], least), np.ones(int(held.sum()), np.int64))
        rows = [("follows", bucket, None, pack(half[a:b], twice[a:b], kinds[a:b])) for bucket, a, b in split_sorted(half << _HALF, count)]
        if small:
            rows.append(("bits", me, None, bits.tobytes()))
        else:
            found = CountFilter(bits if len(bits) else np.zeros(1, np.uint8), np.zeros(1, np.int64), np.array([8 * len(bits)]), probes).levels(known).astype(np.uint8)
            rows += [("levels", me, number, pack(found[np.searchsorted(known, k)])) for number, k in zip(numbers.tolist(), own, strict=True)]
        kind, bucket, number, payload = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.table({"kind": pa.array(kind, pa.string()), "bucket": pa.array(bucket, pa.int32()), "block_id": pa.array(number, pa.int64()), "payload": pa.array(payload, pa.binary())})

    built = blocks.stage.put(blocks.messages(pairs).groupBy("bucket").applyInArrow(segment, "kind string, bucket int, block_id long, payload binary"), "pairs")
    told = lambda kind: built.where(F.col("kind") == kind).drop("kind")

    def send(block: Block) -> Iterator[tuple[int, bytes]]:
        tokens = _Tokens(block, parts, held_part)
        known, seen = _counted(tokens.keys, tokens.train)
        for bucket, a, b in split_sorted(known, count):
            yield bucket, flat(known[a:b], _narrow(seen[a:b]))

    def sums(payloads: list[bytes]) -> list[int]:
        _, counts, _ = _summed(payloads)
        return [int(counts.sum()), int((counts > 0).sum())]

    words = blocks.ask("words", send, _totals, sums, beside=told("follows").drop("block_id"))
    total, kinds = words.where("totals IS NOT NULL").agg(F.sum(F.get("totals", F.lit(0))), F.sum(F.get("totals", F.lit(1)))).first()
    total, kinds = int(total or 0), int(kinds or 0)

    shared = None
    if small:
        found = {r.bucket: r.payload for r in told("bits").collect()}
        lengths = np.array([len(found.get(b, b"")) for b in range(count)], np.int64)
        data = np.frombuffer(b"".join(found.get(b, b"") for b in range(count)) or b"\0", np.uint8)
        shared = spark.sparkContext.broadcast(CountFilter(data, np.cumsum(lengths) - lengths, lengths * 8, probes))
    else:
        blocks.answers["pairs"] = told("levels")

    def score(block: Block) -> Iterator[pa.RecordBatch]:
        tokens = _Tokens(block, parts, held_part)
        known = distinct(tokens.keys)
        counts, twice, follow = _answered(known, block.answers.get("words", {}), count, 3)
        place = np.searchsorted(known, tokens.keys)
        own = counts[place]
        simple = (own + 0.1) / (total + 0.1 * (kinds + 1))
        two = tokens.pairs()
        kinds_of_two = distinct(two)
        levels = shared.value.levels(kinds_of_two) if shared else _answered(kinds_of_two, block.answers.get("pairs", {}), count)[0]
        both = twice_count_of(levels, least)[np.searchsorted(kinds_of_two, two)] / 2
        before = np.searchsorted(known, tokens.before)
        held, spread = twice[before] / 2, follow[before]
        # A false positive can't give a pair more than its history has.
        full = np.where(held > 0, (np.minimum(both, held) + spread * simple) / np.maximum(held + spread, 1), simple)
        summed = lambda x: np.add.reduceat(x, tokens.offsets[:-1])
        n = np.diff(tokens.offsets)
        columns = [block.ids, tokens.held_out, n, summed((own > 0).astype(np.int64)), np.full(len(n), total), summed(np.log10(simple)), summed(np.log10(full))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = blocks.map(score, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return blocks.finish(out.withColumn("id", F.when(F.col("id") != NULL_ID, F.col("id"))).withColumnRenamed("id", id_col), "pairs")
