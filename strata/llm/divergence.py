"""Source divergence audit: which terms set a source apart from its language, and which sources differ most.

Terms' document frequencies are first counted in a count-min sketch that tasks fill and ranges of its cells merge: it never
underestimates, so a term with a cell below the limit can't be frequent enough and is dropped before anything is shuffled by term.
Survivors are counted exactly. Sources are then compared through joins of the counts they have; terms that a source doesn't have
enter by closed form, so no table of all sources by all terms is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.staging import Stage
from strata.llm.text import LETTERS, by_bytes, gather, lower, mix, pair, slice_hashes, utf8, word_spans

#: Rows of the sketch; cells of a range that one task merges; bounds of a row's cells (together 64 MB of bits at most); cells held by a task before it sends.
DEPTH, RANGE, LEAST_WIDTH, MOST_WIDTH, HELD = 4, 1 << 16, 1 << 16, 1 << 27, 1 << 22
#: Bytes of text for each cell of a row.
BYTES_A_CELL = 128


@dataclass
class Terms:
    """Terms of a batch: token i of text ``docs[i]`` is term ``codes[i]`` of ``values``, whose hashes are ``hashes``."""

    codes: np.ndarray
    docs: np.ndarray
    values: pa.Array
    hashes: np.ndarray


def terms_of(column: pa.Array) -> Terms:
    """Maximal runs of letters (of ASCII, A-Z lower-cased, and all code points beyond it) of every whole text."""
    data, offsets = utf8(column)
    low = lower(data)
    starts, ends, words = word_spans(low, offsets, LETTERS)
    sizes = ends - starts
    flat = gather(low, starts, sizes)
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(flat)]).dictionary_encode()
    values = found.dictionary
    own, at = utf8(values)
    return Terms(found.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(offsets) - 1), np.diff(words)), values, slice_hashes(own, at[:-1], at[1:], seed=21))


def _coded(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of a column's values, the values, and their hashes."""
    found = column.dictionary_encode()
    own, at = utf8(found.dictionary)
    return found.indices.to_numpy().astype(np.int64), found.dictionary, slice_hashes(own, at[:-1], at[1:], seed=22)


def _cells(langs: np.ndarray, terms: np.ndarray, width: int) -> np.ndarray:
    """The DEPTH cells of each (language, term), a row of the result for each row of the sketch."""
    keys = pair(langs, terms)
    return np.stack([mix(keys + np.uint64(r + 1)) % np.uint64(width) + np.uint64(r * width) for r in range(DEPTH)]).astype(np.int64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, counts, minlength=len(found)).astype(np.int64)


def sketch(rows: DataFrame, width: int, least: int) -> np.ndarray:
    """Bits of the merged sketch's cells that reach ``least``: DEPTH * width of them, 64 MB at most.

    ``rows`` has lang and t. Counts are cut at ``least`` on their way, which keeps the comparison exact.
    """
    small = np.min_scalar_type(least)

    def send(cells: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(np.diff(cells // RANGE, prepend=-1))
        ends = np.append(at[1:], len(cells))
        counts = np.minimum(counts, least).astype(small)
        payloads = [(cells[a:b] % RANGE).astype(np.uint16).tobytes() + counts[a:b].tobytes() for a, b in zip(at, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array((cells[at] // RANGE).astype(np.int32)), pa.array(payloads, pa.binary())], names=["part", "payload"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in by_bytes(batches, 1):
            t, (lang, _, lang_hashes) = terms_of(batch.column(1)), _coded(batch.column(0))
            n = max(len(t.values), 1)
            own = np.unique(t.docs * n + t.codes)
            keys, df = np.unique(lang[own // n] * n + own % n, return_counts=True)
            more = _cells(lang_hashes[keys // n], t.hashes[keys % n], width)
            cells, counts = _summed(np.concatenate([cells, more.ravel()]), np.concatenate([counts, np.tile(df, DEPTH)]))
            if len(cells) > HELD:
                yield send(cells, counts)
                cells, counts = cells[:0], counts[:0]
        if len(cells):
            yield send(cells, counts)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Messages come range by range."""
        at, total = -1, np.zeros(RANGE, np.int64)
        bits = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], names=["part", "bits"])
        for batch in batches:
            for part, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if part != at:
                    if at >= 0:
                        yield bits()
                    at, total = part, np.zeros(RANGE, np.int64)
                raw = payload.as_buffer()
                k = len(raw) // (2 + small.itemsize)
                np.add.at(total, np.frombuffer(raw, np.uint16, k), np.frombuffer(raw, small, k, 2 * k).astype(np.int64))
        if at >= 0:
            yield bits()

    sent = rows.select("lang", "t").mapInArrow(fill, "part int, payload binary")
    merged = sent.repartition("part").sortWithinPartitions("part").mapInArrow(merge, "part int, bits binary").toArrow()
    out = np.zeros(DEPTH * width // 8, np.uint8)
    for part, bits in zip(merged["part"].to_pylist(), merged["bits"], strict=True):
        at = part * RANGE // 8
        out[at : at + RANGE // 8] = np.frombuffer(bits.as_buffer(), np.uint8)
    return out


def term_counts(rows: DataFrame, width: int, least: int) -> DataFrame:
    """lang, source, term, df and n, exactly, of the terms that the sketch lets through; ``rows`` has lang, source and t."""
    bits = rows.sparkSession.sparkContext.broadcast(sketch(rows, width, least))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 2):
            t, (lang, langs, lang_hashes), (source, sources, _) = terms_of(batch.column(2)), _coded(batch.column(0)), _coded(batch.column(1))
            n, s = max(len(t.values), 1), max(len(sources), 1)
            known, place = np.unique(lang[t.docs] * n + t.codes, return_inverse=True)
            cells = _cells(lang_hashes[known // n], t.hashes[known % n], width)
            possible = np.ones(len(known), dtype=bool)
            for row in cells:
                possible &= (bits.value[row >> 3] >> (7 - (row & 7)).astype(np.uint8) & 1).astype(bool)
            some = possible[place]
            codes, docs = t.codes[some], t.docs[some]
            group = lang * s + source
            keys, tf = np.unique(group[docs] * n + codes, return_counts=True)
            own = np.unique(docs * n + codes)
            df = np.bincount(np.searchsorted(keys, group[own // n] * n + own % n), minlength=len(keys))
            of = keys // n
            yield pa.RecordBatch.from_arrays(
                [langs.take(pa.array(of // s)), sources.take(pa.array(of % s)), t.values.take(pa.array(keys % n)).cast(pa.large_string()).cast(pa.string()), pa.array(df.astype(np.int64)), pa.array(tf.astype(np.int64))],
                names=["lang", "source", "term", "df", "n"],
            )

    found = rows.select("lang", "source", "t").mapInArrow(count, "lang string, source string, term string, df long, n long")
    return found.groupBy("lang", "source", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))


def _share(n: str, total: str, kept: str = "v", scale: int = 1_000_000_000, extra: int = 5) -> Column:
    """1 + floor(scale * (n + extra) / (total + extra * kept)) in whole numbers; null where nothing is kept."""
    return F.expr(f"1 + (cast({scale} as decimal(10, 0)) * cast({n} + {extra} as decimal(20, 0))) div nullif({total} + {extra} * {kept}, 0)")


def audit_sources(docs: DataFrame, least_docs: int = 30, top: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: what sets each (lang, source) apart.

    Each language keeps the terms that at least ``least_docs`` of its documents have. With n occurrences of a kept term in a group, N
    of all kept terms there and V kept terms, the term's share is p = 1 + floor(10^9 (n + 5) / (N + 5 V)). Part ``pair``: every other
    source of the language by the sum of differences of shares over all kept terms. Part ``term``: terms of the source whose share is
    above the language's, by the difference, the first ``top``. Ranks go by value (largest first), then by item in UTF-8 order.

    Null texts, languages and sources count as ''. A group without terms takes part in the pairs; where a language keeps no term the
    pairs have value 0. Repeated rows count as often as they stand; an empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "divergence")
    text = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("t"))
    groups = stage.put(rows.groupBy("lang", "source").agg(F.sum(F.octet_length("t").cast("long")).alias("bytes")), "groups")
    size = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    width = min(max(LEAST_WIDTH, 1 << int(size // BYTES_A_CELL).bit_length()), MOST_WIDTH)

    by_term = Window.partitionBy("lang", "term")
    counts = term_counts(rows, width, least_docs).withColumns({"all_df": F.sum("df").over(by_term), "all_n": F.sum("n").over(by_term), "leads": (F.row_number().over(by_term.orderBy("source")) == 1).cast("long")})
    counts = stage.put(counts.where(F.col("all_df") >= least_docs).select("lang", "source", "term", "n", "all_n", "leads"), "counts")
    langs = counts.groupBy("lang").agg(F.sum("leads").alias("v"), F.sum("n").alias("lang_total"))
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.select("lang", "source").join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "lang_total", "v"))).withColumn("base", _share("0L", "total"))
    groups = stage.put(groups, "totals")

    shares = counts.join(groups, ["lang", "source"]).withColumns({"p": _share("n", "total"), "q": _share("all_n", "lang_total")})
    shares = stage.put(shares.select("lang", "source", "term", "p", "q", "base"), "shares")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    term = ranked(shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")), "term").where(F.col("rank") <= top)
    return ranked(_pairs(shares, groups, stage), "pair").unionByName(term)


def _pairs(shares: DataFrame, groups: DataFrame, stage: Stage) -> DataFrame:
    """lang, source, item and value: the sum of |p - q| over all kept terms, for each two sources of a language.

    Over the terms of both it comes from a join; a term that one alone has is set against the other's share of what it doesn't
    have (its base), by running sums of the one's shares in order; terms of neither all add the difference of the bases.
    """
    own, other = groups.select("lang", "source", "base", "v"), groups.select("lang", F.col("source").alias("item"), F.col("base").alias("item_base"))
    pairs = own.join(other, "lang").where("source <> item")
    # Running sums of the source's shares up to the item's base.
    points = shares.groupBy("lang", "source", F.col("p").alias("at")).agg(F.count(F.lit(1)).alias("k")).select("lang", "source", "at", "k", F.lit(None).cast("string").alias("item"), F.lit(None).cast("long").alias("base"), F.lit(None).cast("long").alias("v"))
    asked = pairs.select("lang", "source", F.coalesce("item_base", F.lit(0)).alias("at"), F.lit(0).cast("long").alias("k"), "item", "base", "v")
    group = Window.partitionBy("lang", "source")
    so_far = group.orderBy("at")
    step = points.unionByName(asked)
    step = step.withColumns({"k0": F.sum("k").over(so_far), "s0": F.sum(F.expr("k * at")).over(so_far), "k1": F.sum("k").over(group), "s1": F.sum(F.expr("k * at")).over(group)})
    sides = step.where("item is not null").select("lang", "source", "item", "v", F.expr("coalesce(abs(base - at), 0)").alias("apart"), F.expr("at * k0 - s0 + (s1 - s0) - at * (k1 - k0)").alias("d"), "k1")
    one_side = sides.select("lang", F.least("source", "item").alias("a"), F.greatest("source", "item").alias("b"), F.expr("d - k1 * apart").alias("value"), F.when(F.col("source") < F.col("item"), F.col("v") * F.col("apart")).otherwise(0).alias("rest"))
    left = shares.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("base").alias("ba"))
    right = shares.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("base").alias("bb"))
    both = left.join(right, ["lang", "term"]).where("a < b")
    both = both.groupBy("lang", "a", "b").agg(F.sum(F.expr("abs(pa - pb) - abs(pa - bb) - abs(ba - pb) + abs(ba - bb)")).alias("value")).withColumn("rest", F.lit(0).cast("long"))
    total = stage.put(one_side.unionByName(both).groupBy("lang", "a", "b").agg((F.sum("value") + F.sum("rest")).alias("value")), "pairs")
    flip = total.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value")
    return total.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(flip)
