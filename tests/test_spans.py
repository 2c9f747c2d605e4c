"""Markup scanned again after edits against whole scans."""

import random

from strata.operators import spans


def test_common_ends(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        a = "".join(rng.choice("ab") for _ in range(rng.choice([0, 1, 5, 255, 256, 257, 700])))
        k = rng.randrange(len(a) + 1)
        b = rng.choice([a, a[:k] + "x" * rng.randrange(4) + a[min(len(a), k + rng.randrange(4)):], a + "a", a[1:], ""])
        rows.append((i, a, b))
    rows.append((300, "\U0001f600é\U0001f601", "\U0001f600è\U0001f601"))
    got = {r.i: (r.head, r.tail) for r in spans.common_ends(spark.createDataFrame(rows, "i int, a string, b string"), "i", "a", "b").collect()}
    for i, a, b in rows:
        h = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        t = next((k for k in range(min(len(a), len(b)) - h) if a[-1 - k] != b[-1 - k]), min(len(a), len(b)) - h)
        assert got[i] == (h, t)


def test_only_the_stretch_between_is_scanned(spark):
    rng = random.Random(2)

    def body(n):
        return [rng.choice(["<p>one</p>", "<p><r>a</r><r>b</r></p>", "<t><c><p>in</p></c></t>", "<br>", "x", "<p/>", "<p>é<b>ü</b></p>"]) for _ in range(n)]

    olds, news = [], []
    for i in range(200):
        a = body(rng.choice([0, 1, 3, 30]))
        b = list(a)
        for _ in range(rng.choice([0, 1, 2])):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(3)] = body(rng.randrange(3))
        b = "".join(b)
        if i % 10 == 1:
            k = rng.randrange(len(b) + 1)
            b = b[:k] + rng.choice(["<p>", "</p>", "<!-- <p> -->", "</t>", "<c>"]) + b[k:]
        a = "".join(a)
        if i % 10 == 2:
            a = rng.choice(["</p>", "<p>", "<!---->"]) + a
        olds.append((i, a if i % 50 else None))
        news.append((i, b))
    news.append((900, "<p>new</p>"))
    olds.append((901, "<p>gone</p>"))
    old, new = (spark.createDataFrame(rows, "k int, x string") for rows in (olds, news))
    found = spans.rescanned(old, new, spans.top_level(old, "k", "x"), spans.tidy(old, "k", "x"), "k", "x").cache()
    columns = ["k", "n", "first", "length", "tag"]
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, spans.top_level(new, "k", "x").select(columns).collect()))
    many = {r["source"]: r["count"] for r in found.groupBy("source").count().collect()}
    assert many["scanned"] < 0.5 * (many["kept"] + many["moved"]) and many["kept"] > 100 and many["moved"] > 100, many
