"""Quality rules: fixed limits on counts, then boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.boosting import Trees, fit_trees
from strata.llm.staging import Stage
from strata.llm.stats import FEATURES, base_counts, segment_features
from strata.llm.text import by_bytes, utf8, word_spans

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the trees see: the segment features of the whole text and two shares.
TREE_FEATURES = (*FEATURES, "repeat_share", "dup_line_share")
#: The verdict may only get worse with these, and is free in the rest.
FALLING = ("symbol", "shout", "mark", "same_as_last", "same_as_last_but_one", "repeat_share", "dup_line_share")


def measure(column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Counts and TREE_FEATURES of each text."""
    data, offsets = utf8(column)
    counts = base_counts(data, offsets)
    starts, ends, words = word_spans(data, offsets)
    some = np.maximum(counts["n_words"], 1)
    shares = [counts["n_repeat_words"] / some, counts["n_dup_lines"] / some]
    return counts, np.column_stack([segment_features(data, starts, ends, words), *shares])


def sample_labels(labels: DataFrame, id_col: str, label_col: str, most: int) -> DataFrame:
    """At most ``most`` labelled ids: those with the smallest hashes, whatever their order in the table."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    return known.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).orderBy(F.xxhash64("id"), "id", "y").limit(most)


def labelled_texts(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str, most_bytes: int, stage: Stage) -> DataFrame:
    """id, y and t of the chosen (id, y), staged: texts of at most a sixteenth of ``most_bytes``, and of ``most_bytes`` together.

    Of rows that share an id the least text counts, so there are no more rows than were chosen.
    """
    chosen = F.broadcast(chosen.withColumn("id", F.col("id").cast("string")))
    rows = docs.select(docs[id_col].cast("string").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("t")).join(chosen, "id")
    rows = rows.where(F.octet_length("t") <= most_bytes // 16)
    rows = stage.put(rows.groupBy("id", "y").agg(F.min("t").alias("t")), "labelled")
    so_far = F.sum(F.octet_length("t").cast("long")).over(Window.orderBy(F.xxhash64("id"), "id", "y"))
    fits = rows.select("id", "y", so_far.alias("so_far")).where(F.col("so_far") <= most_bytes).select("id", "y")
    return rows.join(F.broadcast(fits), ["id", "y"], "left_semi")


def fit_rules(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int, most_bytes: int) -> Trees:
    """Trees fitted to a sample of at most ``most`` labelled documents, of ``most_bytes`` together."""
    width = len(TREE_FEATURES)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            _, x = measure(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(x.ravel(), width).cast(pa.list_(pa.float64()))], names=["y", "x"])

    stage = Stage(docs.sparkSession, "quality_rules")
    rows = labelled_texts(docs, sample_labels(labels, id_col, label_col, most), id_col, text_col, most_bytes, stage).select("y", "t")
    found = rows.mapInArrow(features, "y double, x array<double>").toArrow()
    stage.clear()
    y = found["y"].to_numpy()
    x = np.array(found["x"].combine_chunks().flatten()).reshape(-1, width) if len(y) else np.zeros((0, width))
    order = np.lexsort([y, *x.T])  # the same trees whatever order the rows came in
    return fit_trees(x[order], y[order], np.array([-1 if f in FALLING else 0 for f in TREE_FEATURES]))


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    least_words: int = 20,
    most_repeat_percent: int = 30,
    keep_at: float = 0.5,
    fit_rows: int = 20_000,
    fit_bytes: int = 256 << 20,
) -> DataFrame:
    """One row per document: id, the five counts, base_failed, score and kept.

    A text of fewer than ``least_words`` words, or with more than
    ``most_repeat_percent`` % of its words in repeated 8-word windows, fails. Every other text is kept
    if the trees' probability of label 1 is at least ``keep_at``. The trees are fitted to
    at most ``fit_rows`` labelled documents (``fit_bytes`` of text) and score every row as one array pass per tree level.

    A null or empty text has no words and fails. Null labels and labels of
    unknown ids are ignored; without both labels there are no trees, the score is a constant and every text that
    passes the limits is kept. Repeated rows are judged one by one; an empty table gives no rows.
    """
    trees = fit_rules(docs, labels, id_col, text_col, label_col, fit_rows, fit_bytes)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            counts, x = measure(batch.column(1))
            words, repeat = counts["n_words"], counts["n_repeat_words"]
            failed = (words < least_words) | (100 * repeat > most_repeat_percent * words)
            score = 1 / (1 + np.exp(-trees.margin(x)))
            kept = ~failed & ((score >= keep_at) | (not len(trees.roots)))
            columns = [batch.column(0), *(pa.array(counts[c].astype(np.int64)) for c in COUNTS), pa.array(failed), pa.array(score), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", *COUNTS, "base_failed", "score", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    out = rows.mapInArrow(judge, f"id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, score double, kept boolean")
    return out.withColumnRenamed("id", id_col)
