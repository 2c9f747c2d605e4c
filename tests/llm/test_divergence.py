"""Source divergence against a plain count, through narrow sketches too."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import LOWER
from pyspark.sql import functions as F
from test_llm import AWKWARD, awkward, empty  # noqa: F401

from strata.llm import divergence
from strata.llm.divergence import audit_sources, sketch


def plain(rows, least, top):
    """rows: (text, lang, source)."""
    df, n, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        df[lang or ""].update(set(words))
        n[lang or "", source or ""].update(words)
        groups.add((lang or "", source or ""))
    out = []
    for lang, source in groups:
        kept = [t for t, c in df[lang].items() if c >= least]
        share = lambda count, kept=kept: {t: 1 + 10**9 * (count[t] + 5) // (sum(count[u] for u in kept) + 5 * len(kept)) for t in kept}
        whole = Counter()
        for g in groups:
            if g[0] == lang:
                whole.update(n[g])
        mine, q = share(n[lang, source]), share(whole)
        pair = []
        for other in groups:
            if other[0] == lang and other[1] != source:
                theirs = share(n[other])
                pair.append((other[1], sum(abs(mine[t] - theirs[t]) for t in kept)))
        term = [(t, mine[t] - q[t]) for t in kept if n[lang, source][t] and mine[t] > q[t]]
        order = lambda x: (-x[1], x[0].encode())
        for part, found in (("pair", sorted(pair, key=order)), ("term", sorted(term, key=order)[:top])):
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(found)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(500):
        lang = str(rng.choice(["en", "fr", ""], p=[0.6, 0.3, 0.1]))
        source = int(rng.zipf(1.6)) % 9
        words = [f"{'AÉbc'[int(k) % 4]}w{'xyzß'[int(k) // 4 % 4]}{'' if k % 3 else 'é'}" + "q" * (int(k) % 5 + source % 2) for k in rng.zipf(1.3, int(rng.integers(0, 60))) % 400]
        rows.append((" 7,".join(words), lang or None, f"s{source}" if source else None))
    return rows


@pytest.mark.parametrize(("least", "top"), [(1, 1000), (30, 50), (8, 5), (10**6, 50)])
def test_equals_a_plain_count(spark, corpus, least, top):
    docs = spark.createDataFrame(corpus, "text string, lang string, source string").repartition(7)
    want = plain(corpus, least, top)
    assert got(audit_sources(docs, least_docs=least, top=top)) == want
    assert least > 500 or {r[2] for r in want} == {"pair", "term"}


def test_a_narrow_sketch_drops_no_frequent_term(spark, corpus, monkeypatch):
    monkeypatch.setattr(divergence, "RANGE", 64)
    monkeypatch.setattr(divergence, "HELD", 50)
    for width in (64, 4096):
        monkeypatch.setattr(divergence, "LEAST_WIDTH", width)
        monkeypatch.setattr(divergence, "MOST_WIDTH", width)
        docs = spark.createDataFrame(corpus, "text string, lang string, source string").repartition(7)
        assert got(audit_sources(docs, least_docs=30)) == plain(corpus, 30, 50)
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("t"))
    share = [np.unpackbits(sketch(rows, width, 30)).mean() for width in (64, 1 << 14)]
    assert share[0] > 0.5 and share[1] < 0.05  # the wide one drops nearly all, the narrow one nothing


def test_awkward_rows(spark, awkward, empty):  # noqa: F811
    rows = [(t, "en", "s") for _, t in AWKWARD]
    assert got(audit_sources(awkward, least_docs=2)) == plain(rows, 2, 50)
    more = awkward.unionByName(awkward).unionByName(awkward.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), "n_chars", "h", "id", "t"))
    more = more.unionByName(awkward.where("doc_id < 4").withColumn("source", F.lit("bare")))
    assert got(audit_sources(more, least_docs=2)) == plain(rows * 2 + [(t, None, None) for _, t in AWKWARD] + [(t, "en", "bare") for i, t in AWKWARD if i < 4], 2, 50)
    none = audit_sources(empty)
    assert none.count() == 0 and none.columns == ["lang", "source", "part", "item", "value", "rank"]
