"""Statistics of texts and of passages of texts, computed for whole Arrow batches at once."""

from __future__ import annotations

import numpy as np

from strata.llm.text import covered, pair, slice_hashes, window_hashes, window_ok, word_spans

_SYMBOLS = b"#*$%&|<>"


def _class(members: bytes | range) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(members)] = True
    return out


_CLASSES = {
    "symbol": _class(_SYMBOLS),
    "upper": _class(range(65, 91)),
    "digit": _class(range(48, 58)),
    "stop": _class(b".?,;:"),
    "shout": _class(b"!"),
    "mark": _class(b"{}[]()=/\\_@~^\""),
    "tail": ~_class(range(0x80, 0xC0)),
}
#: Names of segment_features' columns, in order.
FEATURES = ("log_words", "word_chars", "symbol", "upper", "digit", "stop", "shout", "mark", "distinct", "same_as_last", "same_as_last_but_one", "long_words")


def ids_of(offsets: np.ndarray) -> np.ndarray:
    """The number of the text that each item belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item, whether its key occurs again anywhere, and whether it occurs at a smaller index."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = np.zeros(len(keys) + 1, dtype=bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    any_, later = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    any_[order] = same[:-1] | same[1:]
    later[order] = same[:-1]
    return any_, later


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n = len(offsets) - 1
    starts, ends, words = word_spans(data, offsets)
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[offsets])
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends[ends < len(data)]] -= 1
    in_word = np.cumsum(inside[:-1], dtype=np.int8) > 0
    out = {"n_words": np.diff(words), "word_chars": total(in_word & _CLASSES["tail"][data]), "n_symbols": total(_CLASSES["symbol"][data])}

    cut = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10) + 1]))
    first = cut[:-1] if len(cut) > 1 else cut[:0]
    last = cut[1:].copy()
    last -= (data[last - 1] == 10).astype(np.int64) if len(last) else 0
    owner = np.searchsorted(offsets, first, side="right") - 1
    held = np.searchsorted(starts, last) > np.searchsorted(starts, first)
    first, last, owner = first[held], last[held], owner[held]
    _, later = repeats(pair(slice_hashes(data, first, last), owner.astype(np.uint64)))
    out["n_dup_lines"] = np.bincount(owner[later], minlength=n)

    width = 8
    windows = window_hashes(slice_hashes(data, starts, ends), width)
    ok = np.flatnonzero(window_ok(words, width))
    owner = ids_of(words)
    twice, _ = repeats(pair(windows[ok], owner[ok].astype(np.uint64)))
    out["n_repeat_words"] = np.bincount(owner[covered(ok[twice], width, len(starts))], minlength=n)
    return out


def segment_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """FEATURES of the segments [segments[i], segments[i + 1]) of words, each from its first word to the end of its last: an array of n rows."""
    n = len(segments) - 1
    count = np.diff(segments)
    some = np.maximum(count, 1).astype(np.float64)
    held = np.flatnonzero(count)
    first, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
    first[held], last[held] = starts[segments[held]], ends[segments[held + 1] - 1]
    summed = {}
    for k, c in _CLASSES.items():
        running = np.concatenate([[0], np.cumsum(c[data], dtype=np.int32 if len(data) < 2**31 else np.int64)])
        summed[k] = (running[last] - running[first]).astype(np.float64)
    chars = np.maximum(summed["tail"], 1)
    hashes = slice_hashes(data, starts, ends)
    owner = ids_of(segments)
    _, later = repeats(pair(hashes, owner.astype(np.uint64)))
    back = []
    for step in (1, 2):
        same = np.zeros(len(hashes), dtype=bool)
        same[step:] = (hashes[step:] == hashes[:-step]) & (owner[step:] == owner[:-step])
        back.append(np.bincount(owner[same], minlength=n) / some)
    long_ = np.bincount(owner[(ends - starts) > 24], minlength=n) / some
    columns = [np.log1p(count), summed["tail"] / some]
    columns += [summed[k] / chars for k in ("symbol", "upper", "digit", "stop", "shout", "mark")]
    columns += [1 - np.bincount(owner[later], minlength=n) / some, *back, long_]
    return np.stack(columns, axis=1) if n else np.zeros((0, len(FEATURES)))
