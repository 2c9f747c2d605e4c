"""Hyphenation by competing patterns: a packed trie for each language, walked from every letter of many words at once."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Patterns of all languages together that are sent to the workers as tries (some 100 bytes each).
MOST = 1_000_000


class Trie:
    """Patterns (letters with digits between them) as sorted edges (node, letter) -> node, and each node's digits."""

    def __init__(self, patterns: Sequence[str]):
        edges: dict[tuple[int, int], int] = {}
        digits: dict[int, list[int]] = {}
        for pattern in patterns:
            letters = re.sub("[0-9]", "", pattern)
            values, k = [0] * (len(letters) + 1), 0
            for c in pattern:
                if c in "0123456789":
                    values[k] = int(c)
                else:
                    k += 1
            node = 0
            for c in letters:
                node = edges.setdefault((node, ord(c)), len(edges) + 1)
            old = digits.get(node, [0] * len(values))
            digits[node] = [max(a, b) for a, b in zip(old, values, strict=True)]
        keys = np.array([(n << 21) | c for n, c in edges], np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.array(list(edges.values()), np.int64)[order]
        sizes = np.array([len(digits.get(n, ())) for n in range(len(edges) + 1)], np.int64)
        self.first, self.sizes = np.cumsum(sizes) - sizes, sizes
        self.values = np.array([v for n in range(len(edges) + 1) for v in digits.get(n, ())], np.int8)

    def gaps(self, text: np.ndarray) -> np.ndarray:
        """Of letters (code points, words between full stops, 0 after each), the greatest digit before each one."""
        out = np.zeros(len(text) + 1, np.int8)
        begin, node = np.arange(len(text)), np.zeros(len(text), np.int64)
        depth = 0
        while len(begin) and len(self.keys):
            at = begin + depth
            inside = at < len(text)
            begin, node, at = begin[inside], node[inside], at[inside]
            key = (node << 21) | text[at]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[place] == key
            begin, node, depth = begin[found], self.to[place[found]], depth + 1
            some = self.sizes[node] > 0
            n = self.sizes[node[some]]
            shift = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            np.maximum.at(out, np.repeat(begin[some], n) + shift, self.values[np.repeat(self.first[node[some]], n) + shift])
        return out


def break_points(words: Sequence[str], trie: Trie, left: int, right: int) -> list[list[int]]:
    """For each word the numbers of letters after which it may break: odd digits, ``left`` and ``right`` letters from its ends."""
    joined = "\0".join(f".{w}." for w in words) + "\0"
    text = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
    sizes = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(sizes + 3) - sizes - 2
    odd = np.flatnonzero(trie.gaps(text) % 2 == 1)
    owner = np.searchsorted(starts, odd, side="right") - 1
    ok = owner >= 0
    odd, owner = odd[ok], owner[ok]
    gap = odd - starts[owner]
    ok = (gap >= left) & (gap <= sizes[owner] - right)
    out: list[list[int]] = [[] for _ in words]
    for o, g in zip(owner[ok].tolist(), gap[ok].tolist(), strict=True):
        out[o].append(g)
    return out


def hyphenated(words: DataFrame, patterns: DataFrame, minima: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """(lang, word, points) of distinct words (lang, word): the letters after which each may break, as '2,5'.

    ``patterns``: lang and pattern ('a1b', '.un1'), as ``sources.patterns`` reads them; of all found in '.word.' (lower case) the greatest digit of each gap counts, and odd ones may break.
    ``minima``: lang, left and right, the letters that stay together at the ends (2 where a language states none). ``exceptions`` (lang, word, points) go first.
    Each word is met once and walked through its language's trie; a word of a language without patterns doesn't break. There may be MOST patterns; nulls and empty words are left out.
    """
    spark = words.sparkSession
    given = patterns.where("lang IS NOT NULL AND pattern <> ''").distinct()
    if (many := given.limit(MOST + 1).count()) > MOST:
        raise ValueError(f"more than {MOST} patterns ({many})")
    by: dict[str, list[str]] = {}
    for r in given.collect():  # bounded by MOST
        by.setdefault(r.lang, []).append(r.pattern.lower())
    least = {r.lang: (r.left, r.right) for r in minima.select("lang", "left", "right").limit(MOST).collect()}
    shared = spark.sparkContext.broadcast(({lang: Trie(sorted(p)) for lang, p in by.items()}, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries, ends = shared.value
        for batch in batches:
            langs, own = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            points = [""] * len(own)
            for lang in set(langs) & set(tries):
                some = [k for k, x in enumerate(langs) if x == lang]
                for k, found in zip(some, break_points([own[k].lower() for k in some], tries[lang], *ends.get(lang, (2, 2))), strict=True):
                    points[k] = ",".join(map(str, found))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(points, pa.string())], names=["lang", "word", "points"])

    out = words.where("lang IS NOT NULL AND word <> ''").select("lang", "word").distinct().mapInArrow(run, "lang string, word string, points string")
    if exceptions is None:
        return out
    known = exceptions.select("lang", F.lower("word").alias("__w"), F.col("points").alias("__p"))
    lowered = out.withColumn("__w", F.lower("word")).join(known, ["lang", "__w"], "left")
    return lowered.select("lang", "word", F.coalesce("__p", "points").alias("points"))
