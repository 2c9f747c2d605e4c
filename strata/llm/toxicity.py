"""Toxic documents and their offending sentences: multiple-instance learning with noisy-or."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.noisy_or import NoisyOr, either, fit_noisy_or, sigmoid
from strata.llm.quality_classifier import held_out_part
from strata.llm.quality_rules import labelled_texts, sample_labels
from strata.llm.staging import Stage
from strata.llm.text import LETTERS, by_bytes, lower, slice_hashes, utf8, word_spans

#: Buckets of hashed features; words of a sentence at most (longer ones are cut); bytes of a word's beginning that count too.
BUCKETS, LONGEST, STEM = 1 << 18, 64, 5

_ENDS = np.zeros(256, dtype=bool)
_ENDS[list(b".!?\n")] = True


@dataclass
class Sentences:
    """Sentences of texts: features[i] is one of sentence owners[i]; text k has [bags[k], bags[k + 1]); starts and ends are byte places."""

    features: np.ndarray
    owners: np.ndarray
    bags: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray


def sentences(column: pa.Array) -> Sentences:
    """Every word of every text is in one sentence: they end at ``.``, ``!``, ``?`` or a line's end, and after LONGEST words.

    A sentence's features are its distinct words (runs of letters, A-Z lower-cased) and its words' first STEM bytes.
    """
    data, offsets = utf8(column)
    low = lower(data)
    starts, ends, words = word_spans(low, offsets, LETTERS)
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(words))
    marks = np.cumsum(_ENDS[data], dtype=np.int64) if len(data) else np.zeros(0, np.int64)
    before = marks[starts] if len(starts) else marks[:0]
    first = np.ones(len(starts), dtype=bool)
    first[1:] = (of[1:] != of[:-1]) | (before[1:] != before[:-1])
    at = np.flatnonzero(first)
    run = np.arange(len(starts)) - np.repeat(at, np.diff(np.append(at, len(starts))))
    first |= run % LONGEST == 0
    at = np.flatnonzero(first)
    owner = np.cumsum(first) - 1
    bags = np.searchsorted(at, words)
    whole = slice_hashes(low, starts, ends, seed=11)
    stem = slice_hashes(low, starts, np.minimum(ends, starts + STEM), seed=12)
    keys = np.concatenate([owner * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64) for h in (whole, stem)])
    keys = np.unique(keys)
    last = np.append(at[1:], len(starts)) - 1
    return Sentences(keys % BUCKETS, keys // BUCKETS, bags, starts[at], ends[last] if len(at) else ends[:0], offsets)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, parts: int, held_part: int, most: int, most_bytes: int) -> NoisyOr:
    """A model fitted to at most ``most`` labelled documents, of ``most_bytes`` together, outside the held-out part.

    Documents longer than a sixteenth of ``most_bytes`` are not fitted.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 2):
            s = sentences(batch.column(2))
            feature_ends = np.searchsorted(s.owners, s.bags)
            features = pa.ListArray.from_arrays(pa.array(feature_ends.astype(np.int32)), pa.array(s.features.astype(np.int32)))
            owners = pa.ListArray.from_arrays(pa.array(feature_ends.astype(np.int32)), pa.array((s.owners - np.repeat(s.bags[:-1], np.diff(feature_ends))).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(s.bags).astype(np.int32)), features, owners], names=["id", "y", "n", "features", "owners"])

    open_ = labels.where(held_out_part(F.col(id_col), parts) != held_part)
    stage = Stage(docs.sparkSession, "toxicity")
    rows = labelled_texts(docs, sample_labels(open_, id_col, label_col, most), id_col, text_col, most_bytes, stage)
    found = rows.mapInArrow(encode, "id string, y double, n int, features array<int>, owners array<int>").toArrow().sort_by([("id", "ascending"), ("y", "ascending")])
    stage.clear()
    bags = np.concatenate([[0], np.cumsum(found["n"].to_numpy())]).astype(np.int64)
    features, owners = found["features"].combine_chunks(), found["owners"].combine_chunks()
    sizes = np.diff(features.offsets.to_numpy()) if len(found) else np.zeros(0, int)
    return fit_noisy_or(features.flatten().to_numpy(), owners.flatten().to_numpy() + np.repeat(bags[:-1].astype(np.int32), sizes), bags, found["y"].to_numpy(), BUCKETS)


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    flag_at: float = 0.3,
    offend_at: float = 0.1,
    parts: int = 4,
    held_part: int = 2,
    fit_rows: int = 4000,
    fit_bytes: int = 24 << 20,
) -> DataFrame:
    """One row per document: id, held_out, score in [0, 1], predicted (1 if score >= flag_at), n_sentences and offending.

    Every sentence of the whole text gets a probability from its words; the document's score is their noisy-or. ``offending`` lists the
    sentences of probability ``offend_at`` or more in text order, as structs of the bytes [start, end) they take in the UTF-8 text and
    their probability; of a document that is flagged, the most probable sentence is always listed. Learned from at most ``fit_rows`` labelled documents
    (``fit_bytes`` of text) outside the held-out part (crc32 of the id as text, modulo ``parts``, equals ``held_part``), chosen by hash;
    only texts enter the model.

    A text without letters (null, empty) has no sentence and score 0. Null labels and labels of unknown ids are ignored; without
    labels of both kinds every sentence has the same small probability. Repeated rows are scored one by one; an empty table gives no rows.
    Columns of docs other than id and text are not read, whatever their names.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, id_col, text_col, label_col, parts, held_part, fit_rows, fit_bytes))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 2):
            if batch.num_rows:
                s = sentences(batch.column(2))
                z = model.value.log_odds(s.features, s.owners, int(s.bags[-1]))
                found = np.clip(either(z, s.bags), 0.0, 1.0)
                of, p = np.repeat(np.arange(batch.num_rows), np.diff(s.bags)), sigmoid(z)
                some = np.flatnonzero(np.diff(s.bags))
                top = np.zeros(batch.num_rows)
                top[some] = np.maximum.reduceat(p, s.bags[some]) if len(some) else top[some]
                bad = np.flatnonzero((p >= offend_at) | ((found >= flag_at)[of] & (p >= top[of])))
                spans = pa.StructArray.from_arrays([pa.array(s.starts[bad] - s.offsets[of[bad]]), pa.array(s.ends[bad] - s.offsets[of[bad]]), pa.array(p[bad])], names=["start", "end", "probability"])
                listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(bad, s.bags).astype(np.int32)), spans)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(found), pa.array((found >= flag_at).astype(np.int32)), pa.array(np.diff(s.bags)), listed],
                    names=["id", "held_out", "score", "predicted", "n_sentences", "offending"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), (held_out_part(F.col(id_col), parts) == held_part).alias("held_out"), F.col(text_col).cast("string").alias("t"))
    out = rows.mapInArrow(score, f"id {kind}, held_out boolean, score double, predicted int, n_sentences long, offending array<struct<start:long,end:long,probability:double>>")
    return out.withColumnRenamed("id", id_col)
