"""Hyphenation by tries against a search for every pattern."""

import random
import re

from strata.operators import layout
from strata.operators.hyphens import Trie, break_points, hyphenated


def plain(word, patterns, left, right):
    dotted = f".{word}."
    gaps = [0] * (len(dotted) + 1)
    for p in patterns:
        letters, digits = re.sub("[0-9]", "", p), re.split("[^0-9]", p)
        for at in range(len(dotted) - len(letters) + 1):
            if dotted[at : at + len(letters)] == letters:
                for k, d in enumerate(digits):
                    gaps[at + k] = max(gaps[at + k], int(d or 0))
    return [g for g in range(left, len(word) - right + 1) if gaps[g + 1] % 2]


def pattern(rng):
    letters = "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 5)))
    out = rng.choice(["", "", "."])
    for c in letters:
        out += rng.choice(["", "", str(rng.randrange(1, 7))]) + c
    return out + rng.choice(["", str(rng.randrange(1, 5))]) + rng.choice(["", "", "."])


def test_tries_find_all_patterns():
    rng = random.Random(1)
    for _ in range(60):
        patterns = [pattern(rng) for _ in range(rng.choice([0, 1, 30, 200]))]
        words = ["".join(rng.choice("abcdéz") for _ in range(rng.randint(1, 14))) for _ in range(40)]
        left, right = rng.choice([(1, 1), (2, 3)])
        assert break_points(words, Trie(patterns), left, right) == [plain(w, patterns, left, right) for w in words]
    assert break_points([], Trie(["a1b"]), 2, 2) == []


def test_languages_minima_and_exceptions(spark):
    words = spark.createDataFrame([("en", "Abcabc"), ("fr", "abcabc"), ("de", "abcabc"), ("en", "abcabc"), ("en", ""), (None, "abc"), ("en", None), ("en", "stated")], "lang string, word string")
    patterns = spark.createDataFrame([("en", "b1c"), ("fr", "b1c"), ("fr", "c1a"), ("en", "a2b"), (None, "a1b")], "lang string, pattern string")
    minima = spark.createDataFrame([("fr", 3, 3)], "lang string, left int, right int")
    stated = spark.createDataFrame([("en", "Stated", "1,3"), ("fr", "abc", "1")], "lang string, word string, points string")
    got = {(r.lang, r.word): r.points for r in hyphenated(words, patterns, minima, stated).collect()}
    assert got == {("en", "Abcabc"): "2", ("en", "abcabc"): "2", ("fr", "abcabc"): "3", ("de", "abcabc"): "", ("en", "stated"): "1,3"}


def test_both_ways_agree(spark):
    rng = random.Random(2)
    patterns = sorted({pattern(rng) for _ in range(60)})
    words = spark.createDataFrame([("x", "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 12)))) for _ in range(150)], "lang string, word string")
    rules = spark.createDataFrame([("x", p) for p in patterns], "lang string, pattern string")
    joined = {r.word: r.points for r in layout.hyphen_points(words, "word", rules).collect()}
    walked = {r.word: r.points for r in hyphenated(words, rules, spark.createDataFrame([], "lang string, left int, right int")).collect()}
    assert joined == walked
