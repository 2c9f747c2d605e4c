"""Document quality by attention-based multiple-instance learning over passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.mil import Attention, fit_attention
from strata.llm.quality_rules import labelled_texts, sample_labels
from strata.llm.staging import Stage
from strata.llm.stats import FEATURES, segment_features
from strata.llm.text import by_bytes, slice_hashes, utf8, word_spans

#: Words of a passage, and buckets of its hashed bag of words.
PASSAGE, BUCKETS = 64, 32
WIDTH = len(FEATURES) + BUCKETS


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A vector for every passage of every text, and the texts' offsets into them.

    All words are in a passage: a text has one for each PASSAGE words or part
    of it, and an empty text one of zero words.
    """
    data, offsets = utf8(column)
    starts, ends, words = word_spans(data, offsets)
    count = np.maximum(-(-np.diff(words) // PASSAGE), 1)
    bags = np.concatenate([[0], np.cumsum(count)])
    inside = np.arange(bags[-1]) - np.repeat(bags[:-1], count)
    first = np.repeat(words[:-1], count) + inside * PASSAGE
    segments = np.append(first, len(starts))
    n = len(first)
    dense = segment_features(data, starts, ends, segments)
    hashed = slice_hashes(data, starts, ends, seed=3)
    owner = np.repeat(np.arange(n), np.diff(segments))
    sign = np.where(hashed >> np.uint64(63), 1.0, -1.0)
    bag = np.bincount(owner * BUCKETS + (hashed % np.uint64(BUCKETS)).astype(np.int64), sign, minlength=n * BUCKETS).reshape(n, BUCKETS)
    return np.column_stack([dense, bag / np.sqrt(np.maximum(np.diff(segments), 1))[:, None]]), bags


def held_out_part(id_col: Column, parts: int) -> Column:
    """crc32 of the id as decimal text, modulo parts."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % parts


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, parts: int, held_part: int, most: int, most_bytes: int) -> Attention:
    """A model fitted to at most ``most`` labelled documents, of ``most_bytes`` together, outside the held-out part.

    Documents longer than a sixteenth of ``most_bytes`` are not fitted.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 2):
            x, bags = passages(batch.column(2))
            flat = pa.ListArray.from_arrays(pa.array((bags * WIDTH).astype(np.int32)), pa.array(x.ravel().astype(np.float32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat], names=["id", "y", "x"])

    open_ = labels.where(held_out_part(F.col(id_col), parts) != held_part)
    stage = Stage(docs.sparkSession, "quality_classifier")
    rows = labelled_texts(docs, sample_labels(open_, id_col, label_col, most), id_col, text_col, most_bytes, stage)
    found = rows.mapInArrow(encode, "id string, y double, x array<float>").toArrow().sort_by([("id", "ascending"), ("y", "ascending")])
    stage.clear()
    x = found["x"].combine_chunks()
    sizes = np.diff(x.offsets.to_numpy()) // WIDTH if len(found) else np.zeros(0, int)
    return fit_attention(np.asarray(x.flatten(), dtype=np.float64).reshape(-1, WIDTH), np.concatenate([[0], np.cumsum(sizes)]), found["y"].to_numpy())


def classify_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    accept_at: float = 0.7,
    parts: int = 4,
    held_part: int = 2,
    fit_rows: int = 3000,
    fit_bytes: int = 64 << 20,
) -> DataFrame:
    """One row per document: id, held_out, score in [0, 1] and predicted (1 if score >= accept_at).

    Every passage of the whole text is encoded and gets a gated attention
    weight; the score is of the weighted sum of the passages. Learned from at most
    ``fit_rows`` labelled documents (``fit_bytes`` of text) outside the held-out part (crc32 of the id as text, modulo ``parts``,
    equals ``held_part``), chosen by hash; only texts enter the model.

    A null text is empty, and an empty text is a document of one passage without words. Null labels
    and labels of unknown ids are ignored; without any label all scores are
    0.5. Repeated rows are scored one by one; an empty table gives no rows.
    """
    model = fit_quality(docs, labels, id_col, text_col, label_col, parts, held_part, fit_rows, fit_bytes)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 2):
            if batch.num_rows:
                x, bags = passages(batch.column(2))
                found = np.clip(model.score(x, bags), 0.0, 1.0)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), pa.array((found >= accept_at).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), (held_out_part(F.col(id_col), parts) == held_part).alias("held_out"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(score, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def drop_low_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    accept_at: float = 0.7,
    parts: int = 4,
    held_part: int = 2,
    fit_rows: int = 3000,
    fit_bytes: int = 64 << 20,
) -> DataFrame:
    """The rows of docs that ``classify_quality`` predicts as 1, with all their columns; nothing is shuffled."""
    model = fit_quality(docs, labels, id_col, text_col, label_col, parts, held_part, fit_rows, fit_bytes)
    place = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, place):
            if batch.num_rows:
                x, bags = passages(batch.column(place))
                yield batch.filter(pa.array(model.score(x, bags) >= accept_at))

    return docs.mapInArrow(keep, docs.schema)
