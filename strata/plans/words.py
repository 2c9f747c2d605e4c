"""Queries over words: hyphenation by the patterns of each language."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import hyphens
from strata.operators.rounds import cut
from strata.plans.registry import query, t

#: Patterns come from the texts: each three letters that a language has often, with a digit from their number after the first two.
_SQL = r"""
    WITH w AS (SELECT lang, lower(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+'))) AS word FROM documents WHERE lang IS NOT NULL),
    d AS (SELECT lang, word, count(*) AS n FROM w GROUP BY 1, 2),
    g AS (SELECT lang, '.' || word || '.' AS x, n FROM d),
    k AS (SELECT lang, x[i:i + 2] AS letters, sum(n)::BIGINT AS n FROM (SELECT lang, x, n, unnest(range(1, len(x) - 1)) AS i FROM g) GROUP BY 1, 2 HAVING sum(n) >= 20),
    p AS (SELECT d.lang, d.word, i, substr('.' || d.word || '.', i, 3) AS letters FROM (SELECT lang, word, unnest(range(1, length(word) + 1)) AS i FROM d) d),
    b AS (SELECT p.lang, p.word, i AS gap, max(k.n % 10) AS digit FROM p JOIN k ON k.lang = p.lang AND k.letters = p.letters GROUP BY 1, 2, 3),
    m AS (SELECT lang, CASE WHEN lang < 'es' THEN 2 ELSE 3 END AS lo, CASE WHEN lang < 'es' THEN 3 ELSE 2 END AS hi FROM (SELECT DISTINCT lang FROM d)),
    o AS (SELECT b.lang, b.word, string_agg(gap::VARCHAR, ',' ORDER BY gap) AS points FROM b JOIN m ON m.lang = b.lang WHERE digit % 2 = 1 AND gap >= lo AND gap <= length(b.word) - hi GROUP BY 1, 2)
    SELECT d.lang, d.word, CASE WHEN d.n % 50 = 0 AND length(d.word) > 4 THEN '4' ELSE coalesce(points, '') END AS points FROM d LEFT JOIN o ON o.lang = d.lang AND o.word = d.word"""


@query("hyphenated_words", _SQL)
def _(spark, sf):
    """Every distinct word with its break points: patterns and exceptions of its language, and how many letters stay together at its ends."""
    docs = t(spark, sf, "documents").where("lang IS NOT NULL")
    words = docs.select("lang", F.explode(F.expr("regexp_extract_all(coalesce(text, ''), '[A-Za-z]+', 0)")).alias("word")).groupBy("lang", F.lower("word").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    words = cut(words)
    dotted = words.select("lang", F.concat(F.lit("."), "word", F.lit(".")).alias("x"), "n")
    grams = dotted.select("lang", "x", "n", F.explode(F.sequence(F.lit(1), F.length("x") - 2)).alias("i")).groupBy("lang", F.expr("substring(x, i, 3)").alias("g")).agg(F.sum("n").alias("n")).where("n >= 20")
    patterns = grams.select("lang", F.concat(F.expr("substring(g, 1, 2)"), (F.col("n") % 10).cast("string"), F.expr("substring(g, 3, 1)")).alias("pattern"))
    early = F.col("lang") < "es"
    minima = words.select("lang").distinct().select("lang", F.when(early, 2).otherwise(3).alias("left"), F.when(early, 3).otherwise(2).alias("right"))
    exceptions = words.where("n % 50 = 0 AND length(word) > 4").select("lang", "word", F.lit("4").alias("points"))
    return hyphens.hyphenated(words, patterns, minima, exceptions)
