"""Queries over the page fold: text beside obstacles with notes at the foot, boxes, and folding again after an edit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.operators import pages, spans
from strata.operators.fold import WORDS, wrapped
from strata.operators.pages import Rules
from strata.operators.rounds import cut
from strata.plans.registry import query, t

_ITEM = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity"
_ITEMS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
_TEXT = Rules(width=60, room=40)


def _paragraphs(text: Column) -> Column:
    """Blocks of a text's paragraphs: words of 12 letters and more have a note, every seventh paragraph an obstacle beside it."""

    def one(p: Column, k: Column) -> Column:
        words = F.transform(F.filter(F.split(p, WORDS), lambda w: w != ""), F.length)
        notes = F.filter(F.transform(words, lambda n, i: F.struct(i.alias("word"), F.when(n >= 12, 1 + n % 5).otherwise(0).alias("lines"))), lambda x: x["lines"] > 0)
        left = F.when(k % 2 == 0, 0).otherwise(35)
        obstacle = F.when(k % 7 == 3, F.struct(left.alias("left"), (left + 25).alias("right"), (3 + k % 5).alias("height"), (k % 3).alias("down")))
        return pages.block(words, notes, obstacle, None, k % 5 == 4, k % 11 == 0, k % 40 == 39)

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), one)


def _documents(spark, sf) -> DataFrame:
    return t(spark, sf, "documents").select("doc_id", _paragraphs(F.col("text")).alias("blocks"))


@query("page_fold")
def _(spark, sf):
    """Every document's text on pages of 40 lines: words beside obstacles, notes at the foot, keeps."""
    return pages.page_fold(_documents(spark, sf), _TEXT).where("kind <> 'page'").drop("carry")


@query("page_resumed")
def _(spark, sf):
    """Documents whose middle paragraph was doubled (every third one), folded again from their old pages: what stayed, what is new and what only moved."""
    text = F.coalesce("text", F.lit(""))
    parts = F.split(text, "\n")
    middle = (F.size(parts) / 2).cast("int")
    edited = F.concat(F.slice(parts, 1, middle + 1), F.slice(parts, middle + 1, F.size(parts)))
    after = F.when(F.col("doc_id") % 3 == 0, F.array_join(edited, "\n")).otherwise(text)
    old, new = _documents(spark, sf), t(spark, sf, "documents").select("doc_id", _paragraphs(after).alias("blocks"))
    return pages.resumed(old, new, cut(pages.page_fold(old, _TEXT)), _TEXT).drop("carry")


def _customer_lines(spark, sf) -> DataFrame:
    """The line items of every customer, in order: their own number n and the length of their note (0: none)."""
    items = t(spark, sf, "lineitem").join(t(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("doc_id")), "l_orderkey")
    note = F.when(F.col("l_returnflag") == "A", F.col("l_quantity").cast("int") % 13).otherwise(0)
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy(*_ITEMS)) - 1
    return items.select("doc_id", n.alias("n"), note.alias("note"))


def _notes_sql(note: str, last: str = "") -> str:
    """Lines and note pieces on pages of 20 lines, line by line; the notes' parts follow from what each line left over."""
    return f"""
    WITH RECURSIVE i AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY {_ITEM}) - 1 AS n, CASE WHEN l_returnflag = 'A' THEN l_quantity::BIGINT % 13 ELSE 0 END AS given
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    l AS (SELECT doc_id, n, {note} AS k FROM i{last}),
    s(doc_id, n, page, body, foot, carry, taken, k) AS (
        SELECT DISTINCT doc_id, -1::BIGINT, 1::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM l
        UNION ALL
        SELECT doc_id, n, page, body, foot + CASE WHEN take > 0 THEN take + sep ELSE 0 END, k - take, take, k
        FROM (SELECT *, least(k, 20 - body - foot - sep) AS take
              FROM (SELECT doc_id, n, k, page + (NOT fits)::BIGINT AS page, CASE WHEN fits THEN body ELSE 0 END + 1 AS body, CASE WHEN fits THEN foot WHEN carry > 0 THEN carry + 1 ELSE 0 END AS foot,
                           CASE WHEN k > 0 AND (CASE WHEN fits THEN foot WHEN carry > 0 THEN carry + 1 ELSE 0 END) = 0 THEN 1 ELSE 0 END AS sep
                    FROM (SELECT l.doc_id, l.n, l.k, page, body, foot, carry, body + 1 + foot + CASE WHEN l.k > 0 THEN 1 + (foot = 0)::BIGINT ELSE 0 END <= 20 AND (l.k = 0 OR carry = 0) AS fits
                          FROM s JOIN l ON l.doc_id = s.doc_id AND l.n = s.n + 1)))),
    p AS (SELECT doc_id, page, 'line' AS kind, n AS block, 0::BIGINT AS first, 1::BIGINT AS count, body - 1 AS y FROM s WHERE n >= 0
          UNION ALL SELECT doc_id, page, 'note', n, 0, taken, foot - taken FROM s WHERE taken > 0
          UNION ALL SELECT doc_id, page + 1, 'note', n, taken, k - taken, 1 FROM s WHERE k > taken)
    SELECT doc_id, page, kind, block, first, count, y FROM p"""


@query("note_pages", _notes_sql("given"))
def _(spark, sf):
    """Line items as lines, with notes at the foot that go on on the next page: every line and every piece of a note on its page."""
    lines = _customer_lines(spark, sf)
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("n", "note"))), lambda x: pages.block(F.array(F.lit(20)), F.array(F.struct(F.lit(0).alias("word"), x["note"].alias("lines")))))
    found = pages.page_fold(lines.groupBy("doc_id").agg(blocks.alias("blocks")), Rules(20, 20, widows=1))
    return found.where("kind <> 'page'").drop("x", "carry")


@query("note_pages_resumed", _notes_sql("CASE WHEN n = m // 2 THEN (given + 5) % 13 ELSE given END", " JOIN (SELECT doc_id, max(n) AS m FROM i GROUP BY 1) USING (doc_id)"))
def _(spark, sf):
    """As ``note_pages`` after the note of every customer's middle line changed, from the old pages: the same rows as a fold of all."""
    lines = _customer_lines(spark, sf)
    changed = lines.withColumn("m", F.max("n").over(Window.partitionBy("doc_id"))).withColumn("note", F.when(F.col("n") == F.expr("m div 2"), (F.col("note") + 5) % 13).otherwise(F.col("note")))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("n", "note"))), lambda x: pages.block(F.array(F.lit(20)), F.array(F.struct(F.lit(0).alias("word"), x["note"].alias("lines")))))
    old, new = (cut(x.groupBy("doc_id").agg(blocks.alias("blocks"))) for x in (lines, changed))
    rules = Rules(20, 20, widows=1)
    return pages.resumed(old, new, cut(pages.page_fold(old, rules)), rules).where("kind <> 'page'").drop("x", "carry", "source")


@query(
    "boxes_around_obstacles",
    f"""
    WITH RECURSIVE i AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ITEM}) - 1 AS n, 10 + l_partkey % 50 AS w, 2 + l_quantity::BIGINT % 7 AS h,
            l_suppkey % 2 = 0 AS o, CASE WHEN l_partkey % 2 = 0 THEN 0 ELSE 50 - l_suppkey % 20 END AS ol, CASE WHEN l_partkey % 2 = 0 THEN 20 + l_suppkey % 20 ELSE 60 END AS orr, 3 + l_partkey % 9 AS oh FROM lineitem),
    s(doc_id, n, page, y, obs, top, x, oy, placed, shown) AS (
        SELECT DISTINCT doc_id, -1::BIGINT, 1::BIGINT, 0::BIGINT, []::STRUCT(t BIGINT, b BIGINT, l BIGINT, r BIGINT)[], 0::BIGINT, 0::BIGINT, NULL::BIGINT, true, false FROM i
        UNION ALL
        SELECT doc_id, m, CASE WHEN over THEN page + 1 ELSE page END, CASE WHEN over THEN 0 WHEN fits THEN z + h ELSE below END,
               CASE WHEN over THEN [] ELSE obs END, z, l, CASE WHEN over THEN NULL ELSE oy END, fits AND NOT over, NOT over
        FROM (SELECT *, NOT empty AND ((fits AND z + h > 30) OR (NOT fits AND below + h > 30) OR (o AND oy + oh > 30)) AS over
              FROM (SELECT *, r - l >= w OR below IS NULL AS fits FROM (SELECT *, coalesce(list_max(list_transform(list_filter(near, lambda q: q.l = 0), lambda q: q.r)), 0) AS l, coalesce(list_min(list_transform(list_filter(near, lambda q: q.l > 0), lambda q: q.l)), 60) AS r,
                             list_min(list_transform(near, lambda q: q.b)) AS below
                    FROM (SELECT *, list_filter(obs, lambda q: q.t < z + h AND q.b > z) AS near
                          FROM (SELECT i.doc_id, i.n AS m, i.w, i.h, i.o, i.oh, s.page, s.y AS z, CASE WHEN s.placed THEN CASE WHEN i.o THEN s.y END ELSE coalesce(s.oy, CASE WHEN i.o THEN s.y END) END AS oy,
                                       CASE WHEN i.o AND (s.placed OR NOT s.shown) THEN list_append(s.obs, {{t: s.y, b: least(s.y + i.oh, 30), l: i.ol::BIGINT, r: i.orr::BIGINT}}) ELSE s.obs END AS obs,
                                       len(s.obs) = 0 AND s.y = 0 AS empty
                                FROM s JOIN i ON i.doc_id = s.doc_id AND i.n = s.n + s.placed::BIGINT)))))),
    d AS (SELECT s.*, w, h, o, ol, orr, oh FROM s JOIN i ON i.doc_id = s.doc_id AND i.n = s.n WHERE placed)
    SELECT doc_id, page, 'box' AS kind, n AS block, x, top AS y FROM d
    UNION ALL SELECT doc_id, page, 'obstacle', n, ol, oy FROM d WHERE o""",
)
def _(spark, sf):
    """Line items as boxes, stacked; half of them come with an obstacle at a side, and boxes stand beside all obstacles of their page or below them."""
    side, k, s = F.col("l_partkey") % 2 == 0, F.col("l_partkey"), F.col("l_suppkey")
    box = F.struct((10 + k % 50).alias("width"), (2 + F.col("l_quantity").cast("long") % 7).alias("height"))
    obstacle = F.when(s % 2 == 0, F.struct(F.when(side, 0).otherwise(50 - s % 20).alias("left"), F.when(side, 20 + s % 20).otherwise(60).alias("right"), (3 + k % 9).alias("height"), F.lit(0).alias("down")))
    rows = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct(*_ITEMS, pages.block(None, None, obstacle, box).alias("block")))).alias("rows"))
    found = pages.page_fold(rows.select("doc_id", F.col("rows.block").alias("blocks")), Rules(60, 30))
    return found.where("kind <> 'page'").select("doc_id", "page", "kind", "block", "x", "y")


def _markup(parts: Column) -> Column:
    """Paragraphs as elements, each with two runs inside."""
    return F.array_join(F.transform(parts, lambda p, k: F.concat(F.lit("<p><r>"), F.replace(p, F.lit("<"), F.lit("&lt;")), F.lit("</r>"), F.when(k % 3 == 1, F.lit("<br>")).otherwise(F.lit("")), F.lit("<r/></p>"))), "")


@query(
    "spans_rescanned",
    """
    WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents),
    e AS (SELECT doc_id, len(w) AS m, CASE WHEN doc_id % 3 = 0 THEN list_concat(w[1:len(w) // 2 + 1], w[len(w) // 2 + 1:]) WHEN doc_id % 3 = 1 THEN list_concat(w[1:len(w) // 2], w[len(w) // 2 + 2:]) ELSE w END AS w FROM d),
    p AS (SELECT doc_id, unnest(w) AS p, unnest(range(1, len(w) + 1)) AS n FROM e),
    l AS (SELECT doc_id, n, length(replace(p, '<', '&lt;')) + 18 + CASE WHEN (n - 1) % 3 = 1 THEN 4 ELSE 0 END AS length FROM p)
    SELECT doc_id, n, (sum(length) OVER (PARTITION BY doc_id ORDER BY n) - length)::BIGINT AS first, length::BIGINT AS length, 'p' AS tag FROM l""",
)
def _(spark, sf):
    """Elements of documents in which a paragraph was doubled or removed: only what lies between the versions' common ends is scanned again."""
    d = t(spark, sf, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("w"))
    middle, size = (F.size("w") / 2).cast("int"), F.size("w")
    doubled = F.concat(F.slice("w", F.lit(1), middle + 1), F.slice("w", middle + 1, size))
    without = F.concat(F.slice("w", F.lit(1), middle), F.slice("w", middle + 2, size))
    after = F.when(F.col("doc_id") % 3 == 0, doubled).when(F.col("doc_id") % 3 == 1, without).otherwise(F.col("w"))
    old, new = cut(d.select("doc_id", _markup(F.col("w")).alias("x"))), cut(d.select("doc_id", _markup(after).alias("x")))
    found, orderly = cut(spans.top_level(old, "doc_id", "x")), cut(spans.tidy(old, "doc_id", "x"))
    return spans.rescanned(old, new, found, orderly, "doc_id", "x").drop("source")


@query(
    "stories_settled",
    r"""
    WITH RECURSIVE g AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS par FROM documents),
    l AS (SELECT doc_id, sum(list_reduce(list_prepend({l: 1::BIGINT, p: 0::BIGINT}, list_transform(list_filter(string_split_regex(par, '[ 	

]+'), lambda w: w <> ''), lambda w: {l: 0::BIGINT, p: length(w)::BIGINT})),
            lambda a, w: CASE WHEN a.p = 0 THEN {l: a.l, p: w.p} WHEN a.p + 1 + w.p <= 30 THEN {l: a.l, p: a.p + 1 + w.p} ELSE {l: a.l + 1, p: w.p} END).l)::BIGINT AS lines FROM g GROUP BY 1),
    s(doc_id, lines, passes, n, story, settled) AS (
        SELECT doc_id, lines, 0, 1::BIGINT, 0::BIGINT, false FROM l
        UNION ALL
        SELECT doc_id, lines, passes + 1, (lines + 12 - h - 1) // (12 - h), h, (lines + 12 - h - 1) // (12 - h) = n
        FROM (SELECT *, least(11, list_reduce(list_prepend({l: 1::BIGINT, p: 0::BIGINT}, list_transform(range(1, n + 1), lambda k: {l: 0::BIGINT, p: length(k::VARCHAR)::BIGINT})),
                lambda a, w: CASE WHEN a.p = 0 THEN {l: a.l, p: w.p} WHEN a.p + 1 + w.p <= 30 THEN {l: a.l, p: a.p + 1 + w.p} ELSE {l: a.l + 1, p: w.p} END).l) AS h FROM s WHERE NOT settled AND passes < 6))
    SELECT doc_id, n AS pages, story, passes, settled FROM s WHERE settled OR passes = 6""",
)
def _(spark, sf):
    """A header that lists all pages takes room from every page, so there are more of them: until both agree, six times at most."""

    def one(p: Column) -> Column:
        return pages.block(F.transform(F.filter(F.split(p, WORDS), lambda w: w != ""), F.length))

    docs = t(spark, sf, "documents").select("doc_id", F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), one).alias("blocks"))
    numbers = lambda n: F.array_join(F.sequence(F.lit(1).cast("long"), n).cast("array<string>"), " ")  # noqa: E731
    return pages.with_stories(docs, Rules(30, 12, widows=1), lambda n: wrapped(numbers(n), 30)["lines"], most=6)
