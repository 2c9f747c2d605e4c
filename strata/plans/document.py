"""Queries for rules of documents: lists, tables, colours, baselines, fields, recomputing and diagnostics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strata.functions import numbers as num
from strata.operators import fold, layout, numbering, plan, resolve, spans, style, sweeps, table
from strata.operators.rounds import dealt
from strata.plans.packages import scanned
from strata.plans.registry import query, t
from strata.sources.package import paragraphs

_ITEM = "l_linenumber, l_partkey, l_suppkey, l_quantity"
_ITEMS = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


# --- lists


@query(
    "list_item_labels",
    """
    WITH RECURSIVE x AS (SELECT event_id, user_id, ts, event_id % 3 + 1 AS inst, event_id * 7 % 4 AS lv, CASE WHEN event_id % 3 = 2 THEN 'B' ELSE 'A' END AS l FROM events),
    i AS (SELECT *, row_number() OVER (PARTITION BY user_id, l ORDER BY ts, event_id) AS n FROM x WHERE lv < 3),
    s(user_id, l, n, c0, c1, c2, used, event_id, inst, lv) AS (
        SELECT user_id, l, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, false, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM i WHERE n = 1
        UNION ALL SELECT s.user_id, s.l, i.n, CASE WHEN i.lv = 0 THEN coalesce(c0, CASE i.l WHEN 'A' THEN 0 ELSE -1 END) + 1 ELSE coalesce(c0, CASE i.l WHEN 'A' THEN 1 ELSE 0 END) END,
            CASE WHEN i.lv = 1 THEN CASE WHEN i.inst = 2 AND NOT used THEN 5 ELSE coalesce(c1, CASE i.inst WHEN 2 THEN 4 ELSE 0 END) + 1 END
                 WHEN i.lv = 2 THEN coalesce(c1, CASE i.inst WHEN 2 THEN 5 ELSE 1 END) WHEN i.l = 'B' THEN c1 END,
            CASE WHEN i.lv = 2 THEN coalesce(c2, CASE i.l WHEN 'A' THEN 2 ELSE 0 END) + 1 WHEN i.lv = 1 AND i.l = 'A' THEN c2 END,
            used OR (i.inst = 2 AND i.lv = 1), i.event_id, i.inst, i.lv
        FROM s JOIN i ON i.user_id = s.user_id AND i.l = s.l AND i.n = s.n + 1)
    SELECT x.event_id, CASE x.lv WHEN 0 THEN c0 WHEN 1 THEN c1 WHEN 2 THEN c2 END AS number,
           CASE WHEN x.l = 'A' THEN CASE x.lv WHEN 0 THEN c0 || '.' WHEN 1 THEN c0 || '.' || repeat(chr((97 + (c1 - 1) % 26)::INT), ((c1 - 1) // 26 + 1)::INT) WHEN 2 THEN c0 || '.' || c1 || '.' || c2 END
                ELSE CASE x.lv WHEN 0 THEN c0::VARCHAR WHEN 1 THEN c0 || '-' || c1 WHEN 2 THEN c2::VARCHAR END END AS label
    FROM x LEFT JOIN s ON s.event_id = x.event_id""",
)
def _(spark, sf):
    a = [(0, 1, None, "decimal", "%1.", False), (1, 1, None, "lowerLetter", "%1.%2", False), (2, 3, 1, "decimal", "%1.%2.%3", True)]
    b = [(0, 0, None, "decimal", "%1", False), (1, 1, 0, "decimal", "%1-%2", False), (2, 1, None, "decimal", "%3", False)]
    rows = [(1, "A", *x, False) for x in a] + [(2, "A", k, 5 if k == 1 else s, *r, k == 1) for k, s, *r in a] + [(3, "B", *x, False) for x in b]
    values = ", ".join("(" + ", ".join("NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"'{v}'" for v in r) + ")" for r in rows)
    levels = spark.sql(f"SELECT CAST(c1 AS BIGINT) AS instance, c2 AS list, CAST(c3 AS INT) AS level, CAST(c4 AS BIGINT) AS start, CAST(c5 AS BIGINT) AS restart, c6 AS format, c7 AS text, c8 AS legal, c9 AS override FROM VALUES {values} AS x(c1, c2, c3, c4, c5, c6, c7, c8, c9)")
    e = t(spark, sf, "events").select("event_id", "user_id", "ts", (F.col("event_id") % 3 + 1).alias("instance"), (F.col("event_id") * 7 % 4).cast("int").alias("level"))
    return numbering.list_items(e, ["user_id"], ["ts", "event_id"], levels, depth=3).select("event_id", "number", "label")


# --- tables


_CELLS = f"SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ITEM}) AS r, l_partkey % 3 AS a, l_partkey % 3 + 1 + l_suppkey % 3 AS b, CASE WHEN l_quantity > 25 THEN l_quantity::BIGINT * 100 END AS s FROM lineitem"


@query(
    "fitted_grids",
    f"""
    WITH RECURSIVE c AS ({_CELLS}),
    g(k, r, w) AS (
        SELECT DISTINCT k, 0::BIGINT, [900, 700 + k % 5] FROM c
        UNION ALL SELECT g.k, c.r, CASE WHEN b <= len(w) THEN w ELSE
            w || list_transform(range(greatest(a - len(w), 0)), lambda x: 360::BIGINT)
              || (SELECT list_transform(range(n), lambda i: rest // n + (i < rest % n)::BIGINT) FROM (SELECT n, CASE WHEN s > held THEN s - held ELSE 360 * n END AS rest FROM (SELECT b - greatest(len(w), a) AS n, coalesce(list_sum(w[a + 1:]), 0)::BIGINT AS held))) END
        FROM g JOIN c ON c.k = g.k AND c.r = g.r + 1),
    l AS (SELECT k, arg_max(w, r) AS w FROM g GROUP BY k)
    SELECT k AS l_orderkey, i - 1 AS "column", w[i]::BIGINT AS width FROM (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM l)""",
)
def _(spark, sf):
    r = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ITEMS))
    cells = t(spark, sf, "lineitem").select("l_orderkey", r.alias("r"), F.lit(1).alias("n"), (1 + F.col("l_suppkey") % 3).alias("span"), (F.col("l_partkey") % 3).alias("before"), F.when(F.col("l_quantity") > 25, F.col("l_quantity").cast("long") * 100).alias("stated"))
    cells = table.cell_columns(cells, ["l_orderkey", "r"], "n", "span", "before")
    widths = F.array(F.lit(900).cast("long"), 700 + F.col("l_orderkey") % 5)
    grid = cells.select("l_orderkey").distinct().select("l_orderkey", F.posexplode(widths).alias("column", "width"))
    return table.fitted_grid(cells, "l_orderkey", "r", grid).select("l_orderkey", F.col("column").cast("long").alias("column"), "width")


@query(
    "cell_of_block",
    """
    SELECT b.conv_id, b.turn AS ord, c.turn AS "row", c.turn * 10 AS cell FROM conversations b
    LEFT JOIN conversations c ON c.conv_id = b.conv_id AND c.turn % 3 = 1 AND c.turn % 5 < 4 AND b.turn >= c.turn AND b.turn < c.turn + 2""",
)
def _(spark, sf):
    c = t(spark, sf, "conversations").withColumn("ord", F.col("turn"))
    cells = c.where("turn % 3 = 1").select("conv_id", F.col("turn").alias("row"), (F.col("turn") * 10).alias("cell"), F.col("turn").alias("first_ord"), (F.col("turn") + 2).alias("end_ord"), (F.col("turn") % 5 == 4).alias("nested"))
    return table.cell_of_block(c, cells, ["conv_id"])


@query(
    "cell_gaps",
    """
    WITH e AS (SELECT *, CASE event_type WHEN 'error' THEN 'table' ELSE 'paragraph' END AS kind, event_id % 9 AS before, event_id % 7 AS after_, event_id % 2 = 0 AS ctx FROM events),
    p AS (SELECT *, lag(kind) OVER w AS pk, lag(event_type) OVER w AS ps, lag(after_) OVER w AS pa, lag(ctx) OVER w AS pc FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, CASE WHEN pk IS NULL AND (ctx OR kind = 'table') THEN 0 WHEN pk IS NULL THEN before WHEN kind = 'table' AND pk = 'paragraph' THEN pa WHEN kind = 'table' THEN 0
           WHEN pk = 'table' THEN before WHEN ctx AND pc AND ps = event_type THEN 0 ELSE greatest(before, pa) END AS gap FROM p""",
)
def _(spark, sf):
    e = t(spark, sf, "events").withColumn("kind", F.when(F.col("event_type") == "error", "table").otherwise("paragraph")).withColumn("before", F.col("event_id") % 9).withColumn("after", F.col("event_id") % 7).withColumn("o", F.struct("ts", "event_id"))
    return table.stacked_gaps(e, ["user_id"], "o", "kind", "event_type", "before", "after", F.col("event_id") % 2 == 0).select("event_id", "gap")


@query(
    "lines_that_fit",
    f"""
    WITH s AS (SELECT l_orderkey AS k, sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY {_ITEM}) <= 60 AS f FROM lineitem),
    n AS (SELECT k, count(*) FILTER (f) AS n, count(*) AS a FROM s GROUP BY 1),
    m AS (SELECT k, a, n - (k % 2 = 0 AND a - n = 1)::INT AS n FROM n)
    SELECT k AS l_orderkey, CASE WHEN k % 2 = 0 AND n = 1 AND a > 1 THEN 0 ELSE n END AS fits, a AS "all" FROM m""",
)
def _(spark, sf):
    df = t(spark, sf, "lineitem").withColumn("h", F.col("l_quantity").cast("long")).withColumn("o", F.struct(*_ITEMS))
    return table.stacked_fit(df, ["l_orderkey"], "o", "h", 60, F.col("l_orderkey") % 2 == 0)


@query(
    "table_placement",
    """
    SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 1440 + (9360 - w) // 2 WHEN 1 THEN 1440 + 9360 - w ELSE 1440 + o_orderkey % 700 - CASE WHEN o_custkey % 5 >= 2 THEN 0 ELSE 108 END END AS table_left,
           CASE WHEN m < 0 THEN -m ELSE greatest(m, o_custkey % 1500) END AS margin
    FROM (SELECT *, 2000 + o_custkey % 5000 AS w, o_orderkey % 1600 - 400 AS m FROM orders)""",
)
def _(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    mode = F.when(c % 5 > 0, 13 + c % 5)
    align = F.when(k % 3 == 0, "center").when(k % 3 == 1, "right").otherwise("left")
    left = table.table_left(align, k % 700, 2000 + c % 5000, F.lit(1440), F.lit(10800), F.lit(108), style.from_mode(mode))
    return t(spark, sf, "orders").select("o_orderkey", left.alias("table_left"), table.text_box(k % 1600 - 400, c % 1500).alias("margin"))


# --- fonts, colours, baselines, modes


@query(
    "theme_colours",
    """
    WITH s AS (SELECT c_custkey, 'accent' || c_custkey % 5 AS slot, CASE WHEN c_custkey % 3 = 0 THEN 'auto' ELSE printf('%06x', (c_custkey * 7919 % 16777216)::INT) END AS lit, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 256 END AS tint, CASE WHEN c_custkey % 6 = 1 THEN c_custkey % 256 END AS shade FROM customer),
    m AS (SELECT *, CASE slot WHEN 'accent0' THEN '1040F0' WHEN 'accent1' THEN 'FF8001' WHEN 'accent2' THEN 'FF8001' END AS rgb FROM s),
    p AS (SELECT *, list_transform([1, 3, 5], lambda i: ('0x' || rgb[i:i + 1])::INT) AS v FROM m),
    q AS (SELECT *, CASE WHEN tint IS NULL THEN v ELSE list_transform(v, lambda x: (2 * (x * tint + 255 * (255 - tint)) + 255) // 510) END AS a FROM p),
    r AS (SELECT *, CASE WHEN shade IS NULL THEN a ELSE list_transform(a, lambda x: (2 * x * shade + 255) // 510) END AS b FROM q)
    SELECT c_custkey, CASE WHEN rgb IS NOT NULL THEN printf('%02X%02X%02X', b[1]::INT, b[2]::INT, b[3]::INT) WHEN lit <> 'auto' THEN upper(lit) END AS resolved FROM r""",
)
def _(spark, sf):
    k = F.col("c_custkey")
    df = t(spark, sf, "customer").select("c_custkey", F.concat(F.lit("accent"), k % 5).alias("slot"), F.when(k % 3 == 0, "auto").otherwise(F.lower(F.lpad(F.hex(k * 7919 % 16777216), 6, "0"))).alias("literal"), F.when(k % 4 == 0, k % 256).alias("tint"), F.when(k % 6 == 1, k % 256).alias("shade"))
    slots = spark.sql("SELECT * FROM VALUES ('dk9', '1040F0'), ('accent1', 'FF8001') AS x(theme_slot, rgb)")
    mapping = spark.sql("SELECT * FROM VALUES ('accent0', 'dk9'), ('accent2', 'accent1') AS x(slot, theme_slot)")
    return style.theme_colour(df, slots, mapping, "slot", "literal", F.col("tint"), F.col("shade")).select("c_custkey", "resolved")


@query(
    "mode_rules",
    """
    SELECT o_orderkey, m IS NOT NULL AND m >= 15 AS widow_in_cells, NOT (m IS NOT NULL AND m >= 15) AS padding_outside, m IS NOT NULL AND m >= 14 AS kerned, coalesce(nullif(o_custkey % 3, 2), CASE WHEN o_orderkey % 2 = 0 THEN 0 END, 7) AS setting
    FROM (SELECT *, CASE WHEN o_orderkey % 5 > 0 THEN 11 + o_orderkey % 5 END AS m FROM orders)""",
)
def _(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rules = {"widow_in_cells": (15, True), "padding_outside": (15, False), "kerned": (14, True)}
    layers = style.stated(F.when(c % 3 != 2, c % 3), F.when(k % 2 == 0, 0), F.lit(7))
    return t(spark, sf, "orders").select("o_orderkey", *style.truth_table(rules, F.when(k % 5 > 0, 11 + k % 5)), layers.cast("long").alias("setting"))


@query(
    "sizes_and_baselines",
    """
    WITH s AS (SELECT p_partkey, p_size, p_partkey % 997 AS y, 80 + p_partkey % 61 AS h, 50 + p_partkey % 37 AS above, 20 + p_partkey % 11 AS below, p_partkey % 2 = 0 AS ex FROM part)
    SELECT p_partkey, (2 * p_size * 300 + 144) // 288 AS px, greatest((2 * p_size * 65 + 100) // 200, 2) AS script, least(p_partkey % 9, p_size) AS raised,
           CASE WHEN h % 8 >= 4 THEN floor((y + h) / 8.0 + 0.5) - floor(below / 8.0 + 0.5)
                ELSE floor(y / 8.0 + 0.5) + floor((above - CASE WHEN ex THEN (h % 8) // 2 ELSE h % 8 END) / 8.0 + 0.5) END::BIGINT AS baseline FROM s""",
)
def _(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    row = style.baseline(k % 997, 80 + k % 61, 50 + k % 37, 20 + k % 11, 8, k % 2 == 0)
    return t(spark, sf, "part").select("p_partkey", style.device_size(s).alias("px"), style.script_size(s).alias("script"), style.script_raise(k % 9, s).alias("raised"), row.alias("baseline"))


@query(
    "glyph_coverage",
    """
    WITH v AS (SELECT p_brand AS face, 90 + p_partkey % 30 AS low, 90 + p_partkey % 30 + p_size % 3 AS high FROM part WHERE p_partkey % 7 = 0),
    f AS (SELECT DISTINCT p_brand AS face, dense_rank() OVER (ORDER BY p_brand) AS r FROM part),
    c AS (SELECT DISTINCT p_brand AS face, ascii(ch) AS code FROM (SELECT p_brand, unnest(string_split(p_name, '')) AS ch FROM part) WHERE ch <> ''),
    b AS (SELECT c.code, arg_min(v.face, r) AS face FROM (SELECT DISTINCT code FROM c) c JOIN v ON c.code BETWEEN low AND high JOIN f ON f.face = v.face GROUP BY 1)
    SELECT c.face, c.code, CASE WHEN EXISTS (SELECT 1 FROM v WHERE v.face = c.face AND c.code BETWEEN low AND high) THEN c.face ELSE b.face END AS drawn_by FROM c LEFT JOIN b ON b.code = c.code""",
)
def _(spark, sf):
    """The face that draws each character: its own where that covers it, else the first that does; faces cover intervals of code points."""
    part = t(spark, sf, "part")
    low = 90 + F.col("p_partkey") % 30
    held = part.where("p_partkey % 7 = 0").select(F.col("p_brand").alias("face"), low.alias("low"), (low + F.col("p_size") % 3).alias("high"))
    chars = part.select(F.col("p_brand").alias("face"), F.explode(F.split("p_name", "")).alias("ch")).where("ch <> ''").select("face", F.ascii("ch").alias("at")).distinct()
    faces = part.select(F.col("p_brand").alias("face")).distinct().withColumn("rank", F.dense_rank().over(Window.orderBy("face")))
    return style.by_coverage(chars, faces, held).withColumnRenamed("at", "code")


@query(
    "glyph_fallback",
    """
    WITH c AS (SELECT DISTINCT p_brand AS face, unnest(string_split(p_name, '')) AS ch FROM part),
    f AS (SELECT DISTINCT p_brand AS face, dense_rank() OVER (ORDER BY p_brand) AS r FROM part),
    v AS (SELECT face, ch, r FROM f, (SELECT DISTINCT ch FROM c) WHERE ascii(ch) % (r + 3) > 2)
    SELECT c.face, c.ch, CASE WHEN o.face IS NOT NULL THEN c.face ELSE (SELECT arg_min(v.face, v.r) FROM v WHERE v.ch = c.ch) END AS drawn_by FROM c LEFT JOIN v o ON o.face = c.face AND o.ch = c.ch""",
)
def _(spark, sf):
    chars = t(spark, sf, "part").select(F.col("p_brand").alias("face"), F.explode(F.split("p_name", "")).alias("ch")).where("ch <> ''").distinct()
    faces = t(spark, sf, "part").select(F.col("p_brand").alias("face")).distinct().withColumn("rank", F.dense_rank().over(Window.orderBy("face")).cast("long"))
    # Which face has which character: here by a rule, else a table of the fonts.
    covered = chars.select("ch").distinct().join(faces, F.ascii("ch") % (F.col("rank") + 3) > 2).select("face", "ch")
    return style.by_face(chars, faces, covered)


@query(
    "theme_faces",
    """
    SELECT c_custkey, coalesce(CASE WHEN ref = 'major' AND s = 'Jpan' THEN 'Mincho' END, CASE ref WHEN 'major' THEN 'Head' END, face) AS face
    FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'major' WHEN 1 THEN 'minor' END AS ref, CASE c_custkey % 4 WHEN 0 THEN 'Jpan' WHEN 1 THEN 'Arab' END AS s, CASE WHEN c_custkey % 5 > 0 THEN 'Face' || c_custkey % 5 END AS face FROM customer)""",
)
def _(spark, sf):
    k = F.col("c_custkey")
    df = t(spark, sf, "customer").select("c_custkey", F.when(k % 3 == 0, "major").when(k % 3 == 1, "minor").alias("reference"), F.when(k % 4 == 0, "ja").when(k % 4 == 1, "ar").otherwise("en").alias("lang"), F.when(k % 5 > 0, F.concat(F.lit("Face"), k % 5)).alias("explicit"))
    theme = spark.sql("SELECT * FROM VALUES ('major', 'latin', 'Head'), ('major', 'Jpan', 'Mincho'), ('minor', 'latin', '') AS x(reference, script, typeface)")
    scripts = spark.sql("SELECT * FROM VALUES ('ja', 'Jpan'), ('ar', 'Arab') AS x(lang, script)")
    return style.through_theme(df, theme, scripts).select("c_custkey", "face")


@query(
    "merged_tab_maps",
    "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '720:right,1440:center' WHEN 1 THEN '1440:center' ELSE '360:left,720:left,1440:center' END AS tabs FROM part",
)
def _(spark, sf):
    base = F.expr("map(720, 'left', 1440, 'center')")
    own = F.expr("CASE p_partkey % 3 WHEN 0 THEN map(720, 'right') WHEN 1 THEN map(720, 'clear') ELSE map(360, 'left', 900, 'clear') END")
    entries = F.array_sort(F.map_entries(style.merged_tabs(base, own)))
    return t(spark, sf, "part").select("p_partkey", F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"])), ",").alias("tabs"))


# --- predicates


@query(
    "block_flags",
    """
    SELECT event_id, event_type <> 'error' AND value > 0 AS shown, coalesce(props, '{}') = '{}' AND value < 1 AS is_empty, event_type = 'purchase' AND lead(event_type) OVER w = 'view' AS ends_section, event_id % 10 = 3 AND event_type = 'view' AS drop_cap,
           CASE WHEN event_type = 'error' THEN 'error' WHEN value > 80 THEN 'too long' WHEN event_id % 4 = 0 THEN 'frame' END AS unsupported
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def _(spark, sf):
    kind, value = F.col("event_type"), F.col("value")
    following = F.lead(kind).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    reason = plan.first_reason([("error", kind == "error"), ("too long", value > 80), ("frame", F.col("event_id") % 4 == 0)])
    return t(spark, sf, "events").select(
        "event_id", ((kind != "error") & (value > 0)).alias("shown"), ((F.coalesce("props", F.lit("{}")) == "{}") & (value < 1)).alias("is_empty"), ((kind == "purchase") & (following == "view")).alias("ends_section"), ((F.col("event_id") % 10 == 3) & (kind == "view")).alias("drop_cap"), reason.alias("unsupported")
    )


# --- fields, notes and references


@query(
    "computed_fields",
    """
    WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS page, count(*) OVER (PARTITION BY user_id) AS pages, count(*) OVER (PARTITION BY user_id, event_type) AS in_section FROM events)
    SELECT event_id, CASE event_type WHEN 'view' THEN page::VARCHAR WHEN 'click' THEN pages::VARCHAR WHEN 'purchase' THEN in_section::VARCHAR WHEN 'signup' THEN coalesce((SELECT q.page::VARCHAR FROM p q WHERE q.event_id = p.event_id - 1 AND q.user_id = p.user_id), 'Error! Bookmark not defined.') ELSE coalesce(props->>'k', '') END AS shown,
           event_type = 'error' AS warned FROM p""",
)
def _(spark, sf):
    whole = Window.partitionBy("user_id")
    p = t(spark, sf, "events").withColumn("page", F.row_number().over(whole.orderBy("ts", "event_id"))).withColumn("pages", F.count(F.lit(1)).over(whole)).withColumn("in_section", F.count(F.lit(1)).over(Window.partitionBy("user_id", "event_type")))
    target = p.select("user_id", (F.col("event_id") + 1).alias("event_id"), F.col("page").alias("target"))
    kind = F.col("event_type")
    value = F.when(kind == "view", F.col("page").cast("string")).when(kind == "click", F.col("pages").cast("string")).when(kind == "purchase", F.col("in_section").cast("string")).when(kind == "signup", F.coalesce(F.col("target").cast("string"), F.lit("Error! Bookmark not defined.")))
    # What isn't computed keeps its cached text, and is warned of.
    cached = F.coalesce(F.get_json_object("props", "$.k"), F.lit(""))
    return p.join(target, ["user_id", "event_id"], "left").select("event_id", F.coalesce(value, cached).alias("shown"), value.isNull().alias("warned"))


@query(
    "field_depths",
    """
    WITH s AS (SELECT *, sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END) OVER w AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, (total - least(min(total) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0))::BIGINT AS depth FROM s""",
)
def _(spark, sf):
    df = plan.nesting(t(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_type") == "purchase")
    return df.select("event_id", "depth")


@query(
    "note_first_pages",
    "SELECT l_orderkey, l_returnflag AS note, min(l_linenumber // 2) AS page, count(*) AS uses FROM lineitem GROUP BY 1, 2",
)
def _(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("note")).agg(F.min(F.expr("l_linenumber div 2")).alias("page"), F.count(F.lit(1)).alias("uses"))


@query(
    "notes_of_cell_lines",
    f"SELECT l_orderkey, l_linenumber, l_linestatus, string_agg(l_returnflag || l_partkey, ',' ORDER BY {_ITEM}) AS notes FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2, 3",
)
def _(spark, sf):
    order = F.array_sort(F.collect_list(F.struct(*_ITEMS, F.concat("l_returnflag", "l_partkey").alias("n"))))
    return t(spark, sf, "lineitem").where("l_returnflag <> 'N'").groupBy("l_orderkey", "l_linenumber", "l_linestatus").agg(F.array_join(F.transform(order, lambda x: x["n"]), ",").alias("notes"))


@query("spliced_numbers", "SELECT conv_id, turn, left(x, a) || '[' || turn || ']' || x[a + 1 + CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END:] AS text FROM (SELECT *, coalesce(text, '') AS x, length(coalesce(text, '')) // 2 AS a FROM conversations)")
def _(spark, sf):
    x = F.coalesce("text", F.lit(""))
    at = F.expr("length(x) div 2").cast("int")
    df = t(spark, sf, "conversations").withColumn("x", x).withColumn("a", at)
    return df.select("conv_id", "turn", F.concat(F.expr("left(x, a)"), F.lit("["), F.col("turn"), F.lit("]"), F.expr("substring(x, a + 1 + CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END)")).alias("text"))


@query(
    "line_of_char",
    """
    SELECT event_id, coalesce(last_value(CASE WHEN event_type IN ('view', 'click') THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id), -1) AS line,
           CASE WHEN event_type = 'view' THEN false WHEN event_type = 'error' THEN count(*) FILTER (event_type <> 'view') OVER (PARTITION BY user_id) = count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id) ELSE true END AS takes_part FROM events""",
)
def _(spark, sf):
    w, whole = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("user_id")
    kind = F.col("event_type")
    known = F.last(F.when(kind.isin("view", "click"), F.col("event_id")), ignorenulls=True).over(w)
    only_marks = F.count(F.when(kind != "view", 1)).over(whole) == F.count(F.when(kind == "error", 1)).over(whole)
    return t(spark, sf, "events").select("event_id", F.coalesce(known, F.lit(-1)).alias("line"), F.when(kind == "view", False).when(kind == "error", only_marks).otherwise(True).alias("takes_part"))


@query("ordinals_by_name", "SELECT event_id, event_type || '[' || row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) || ']' AS step FROM events")
def _(spark, sf):
    n = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return t(spark, sf, "events").select("event_id", F.concat("event_type", F.lit("["), n, F.lit("]")).alias("step"))


@query(
    "ranked_substitutes",
    """
    SELECT c_custkey, string_agg(s_suppkey::VARCHAR, ',' ORDER BY d, s_suppkey) AS candidates FROM (
        SELECT c_custkey, s_suppkey, abs(c_acctbal - s_acctbal) AS d, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal - s_acctbal), s_suppkey) AS r
        FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey <> s_suppkey) WHERE r <= 3 GROUP BY 1""",
)
def _(spark, sf):
    c = t(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))
    s = t(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("value"))
    best = sweeps.nearest(c, s, "nation", 3, apart=True)
    return best.groupBy(F.col("id").alias("c_custkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "other"))), lambda x: x["other"].cast("string")), ",").alias("candidates"))


# --- placement and drawing


@query(
    "page_walk",
    f"""
    WITH l AS (SELECT *, 200 + l_quantity::BIGINT AS pitch FROM lineitem)
    SELECT l_orderkey, {_ITEM}, 1440 + (sum(pitch) OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY {_ITEM}))::BIGINT - pitch AS y FROM l""",
)
def _(spark, sf):
    pitch = 200 + F.col("l_quantity").cast("long")
    w = Window.partitionBy("l_orderkey", "l_linestatus").orderBy(*_ITEMS).rowsBetween(Window.unboundedPreceding, -1)
    return t(spark, sf, "lineitem").select("l_orderkey", *_ITEMS, (1440 + F.coalesce(F.sum(pitch).over(w), F.lit(0))).alias("y"))


@query(
    "page_rectangles",
    """
    WITH r AS (SELECT p_partkey, unnest([{k: 'shading', z: 0, x: 0, w: 2 * p_size, h: 12}, {k: 'underline', z: 2, x: 0, w: 2 * p_size, h: 1}, {k: 'border', z: 1, x: 2 * p_size - 1, w: 1, h: 12}]) AS s FROM part)
    SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY s.z) AS seq, s.k AS kind, s.x AS x, s.w AS w, s.h AS h FROM r WHERE s.k <> 'underline' OR p_partkey % 2 = 0""",
)
def _(spark, sf):
    part = lambda kind, rank, x, w, h: F.struct(F.lit(rank).alias("z"), F.lit(kind).alias("kind"), x.alias("x"), w.alias("w"), F.lit(h).alias("h"))
    size = 2 * F.col("p_size")
    rects = F.array(part("shading", 0, F.lit(0), size, 12), part("border", 1, size - 1, F.lit(1), 12), F.when(F.col("p_partkey") % 2 == 0, part("underline", 2, F.lit(0), size, 1)))
    return t(spark, sf, "part").select("p_partkey", F.posexplode(F.array_sort(F.array_compact(rects))).alias("seq", "r")).select("p_partkey", (F.col("seq") + 1).cast("long").alias("seq"), "r.kind", "r.x", "r.w", "r.h")


@query(
    "beside_or_below",
    """
    WITH o AS (SELECT user_id, event_id % 400 AS top, event_id % 400 + 40 AS bottom, event_id % 5 * 50 AS w FROM events WHERE event_type = 'error'),
    b AS (SELECT event_id, user_id, event_id % 300 AS y, 100 + event_id % 7 * 20 AS need FROM events WHERE event_type = 'view'),
    c AS (SELECT event_id, user_id, need, y AS z FROM b UNION SELECT event_id, b.user_id, need, bottom FROM b JOIN o ON o.user_id = b.user_id AND bottom > y)
    SELECT event_id, min(z) AS y FROM c WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.user_id = c.user_id AND o.top < c.z + 20 AND o.bottom > c.z AND 300 - o.w < c.need) GROUP BY 1""",
)
def _(spark, sf):
    e = t(spark, sf, "events")
    k = F.col("event_id")
    obstacles = e.where("event_type = 'error'").select("user_id", (k % 400).alias("top"), (k % 400 + 40).alias("bottom"), (k % 5 * 50).alias("width"))
    blocks = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("id"), (k % 300).alias("y"), (100 + k % 7 * 20).alias("need"))
    return sweeps.lowest_free(blocks, obstacles, "user_id", 20, 300).select(F.col("id").alias("event_id"), "y")


@query(
    "polygon_extents",
    """
    WITH v AS (SELECT s_suppkey AS k, [{x: 0, y: 0}, {x: 60 + s_suppkey % 40, y: 20 + s_suppkey % 30}, {x: s_suppkey % 50, y: 90}] AS p FROM supplier),
    e AS (SELECT k, unnest([{a: p[1], b: p[2]}, {a: p[2], b: p[3]}, {a: p[3], b: p[1]}]) AS s FROM v),
    c AS (SELECT k, unnest([greatest(least(s.a.y, s.b.y), 30), least(greatest(s.a.y, s.b.y), 50)]) AS y, s FROM e WHERE least(s.a.y, s.b.y) < 50 AND greatest(s.a.y, s.b.y) > 30)
    SELECT k AS s_suppkey, round(min(s.a.x + (s.b.x - s.a.x) * (y - s.a.y) / (s.b.y - s.a.y)::DOUBLE), 6) AS low, round(max(s.a.x + (s.b.x - s.a.x) * (y - s.a.y) / (s.b.y - s.a.y)::DOUBLE), 6) AS high FROM c WHERE s.a.y <> s.b.y GROUP BY 1""",
)
def _(spark, sf):
    """The x-extent of each polygon inside the band 30 to 50, by its edges."""
    p = t(spark, sf, "supplier").select("s_suppkey", F.expr("array(named_struct('x', 0L, 'y', 0L), named_struct('x', 60 + s_suppkey % 40, 'y', 20 + s_suppkey % 30), named_struct('x', s_suppkey % 50, 'y', 90L))").alias("p"))
    edges = p.select("s_suppkey", F.explode(F.expr("transform(p, (a, i) -> named_struct('a', a, 'b', p[(i + 1) % size(p)]))")).alias("e")).select("s_suppkey", "e.a", "e.b")
    edges = edges.withColumn("low_y", F.greatest(F.least("a.y", "b.y"), F.lit(30))).withColumn("high_y", F.least(F.greatest("a.y", "b.y"), F.lit(50))).where("low_y < 50 AND high_y > 30 AND low_y <= high_y AND a.y <> b.y")
    ends = edges.select("s_suppkey", "a", "b", F.explode(F.array("low_y", "high_y")).alias("y"))
    x = F.col("a.x") + (F.col("b.x") - F.col("a.x")) * (F.col("y") - F.col("a.y")) / (F.col("b.y") - F.col("a.y"))
    return ends.groupBy("s_suppkey").agg(F.round(F.min(x), 6).alias("low"), F.round(F.max(x), 6).alias("high"))


# --- recomputing


@query(
    "change_plan",
    """
    SELECT coalesce(a.k, b.k) AS o_orderkey, CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'removed' WHEN a.settings IS DISTINCT FROM b.settings THEN 'settings' WHEN a.styles <> b.styles THEN 'styles' WHEN a.body <> b.body THEN 'body' ELSE 'none' END AS reason,
           CASE WHEN a.k IS NULL OR b.k IS NULL OR a.settings IS DISTINCT FROM b.settings THEN false ELSE a.styles = b.styles END AS measurements_kept
    FROM (SELECT o_orderkey AS k, nullif(o_custkey % 4, 0) AS settings, o_custkey % 9 AS styles, o_custkey AS body FROM orders WHERE o_orderkey % 10 > 0) a
    FULL JOIN (SELECT o_orderkey AS k, nullif(o_custkey % 4, 0) + (o_orderkey % 13 = 0)::INT AS settings, o_custkey % 9 + (o_orderkey % 7 = 0)::INT AS styles, o_custkey + (o_orderkey % 3 = 0)::INT AS body FROM orders WHERE o_orderkey % 10 < 9) b ON a.k = b.k""",
)
def _(spark, sf):
    o, k, c = t(spark, sf, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    settings = F.when(c % 4 != 0, c % 4)
    old = o.where(k % 10 > 0).select("o_orderkey", settings.alias("settings"), (c % 9).alias("styles"), c.alias("body"))
    new = o.where(k % 10 < 9).select("o_orderkey", (settings + (k % 13 == 0).cast("int")).alias("settings"), (c % 9 + (k % 7 == 0).cast("int")).alias("styles"), (c + (k % 3 == 0).cast("int")).alias("body"))
    return plan.change_plan(old, new, "o_orderkey", [("settings", False), ("styles", False), ("body", True)])


@query(
    "spliced_pages",
    """
    WITH d AS (SELECT conv_id, min(turn) FILTER (length(text) % 5 = 0) AS a, max(turn) FILTER (length(text) % 5 = 0) AS b FROM conversations GROUP BY 1)
    SELECT c.conv_id, turn, CASE WHEN turn >= a AND turn <= b THEN 'fresh' ELSE 'kept' END AS source FROM conversations c JOIN d USING (conv_id)""",
)
def _(spark, sf):
    c = t(spark, sf, "conversations").withColumn("state", F.length("text"))
    edited = c.withColumn("state", F.when(F.col("state") % 5 == 0, -1).otherwise(F.col("state")))
    return plan.spliced(c, edited, ["conv_id", "turn"], "state").select("conv_id", "turn", "source")


@query("bounded_cache", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) <= 2")
def _(spark, sf):
    return plan.bounded(t(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"], 2).select("user_id", "event_type", "event_id")


@query("warning_log", "SELECT user_id, 'layout-approximate:' || event_type AS code, (event_id % 3)::VARCHAR AS message, count(*) AS times, min(event_id) AS first_event_id FROM events GROUP BY ALL")
def _(spark, sf):
    e = t(spark, sf, "events").withColumn("code", F.concat(F.lit("layout-approximate:"), "event_type")).withColumn("message", (F.col("event_id") % 3).cast("string"))
    return plan.warning_log(e, ["user_id"], "code", "message", ["event_id"])


@query(
    "parse_memo",
    """
    WITH o AS (SELECT DISTINCT sha256(coalesce(text, '')) AS h FROM documents WHERE doc_id % 3 = 0), n AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents)
    SELECT doc_id, h IN (SELECT h FROM o) AS reused, row_number() OVER (PARTITION BY h ORDER BY doc_id) = 1 AND h NOT IN (SELECT h FROM o) AS parsed FROM n""",
)
def _(spark, sf):
    n = t(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    known = n.where("doc_id % 3 = 0").select("h").distinct().withColumn("known", F.lit(True))
    first = n.groupBy("h").agg(F.min("doc_id").alias("first"))
    found = n.join(known, "h", "left").join(first, "h")
    return found.select("doc_id", F.col("known").isNotNull().alias("reused"), (F.col("known").isNull() & (F.col("doc_id") == F.col("first"))).alias("parsed"))


@query("advance_units", "SELECT p_partkey, (2 * (p_partkey % 2049) * p_size * 2048 + 1000) // 2000 AS units FROM part")
def _(spark, sf):
    return t(spark, sf, "part").select("p_partkey", num.half_up((F.col("p_partkey") % 2049) * F.col("p_size") * 2048, 1000).alias("units"))


# --- markup, pictures, lengths, line predicates, passes


@query(
    "top_level_spans",
    """
    WITH p AS (SELECT page_id, unnest(string_split(coalesce(html, ''), '<')) AS piece, generate_subscripts(string_split(coalesce(html, ''), '<'), 1) - 1 AS i FROM pages),
    s AS (SELECT *, lower(regexp_extract(piece, '^/?([A-Za-z][A-Za-z0-9]*)', 1)) AS tag, length(piece) + (i > 0)::INT AS size FROM p WHERE i > 0 OR piece <> ''),
    d AS (SELECT *, CASE WHEN i = 0 OR tag = '' OR tag IN ('area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'link', 'meta', 'source', 'track', 'wbr') THEN 0 WHEN piece[1] = '/' THEN -1 WHEN regexp_matches(piece, '^[^>]*/>') THEN 0 ELSE 1 END AS step FROM s),
    e AS (SELECT *, sum(step) OVER w AS depth, sum(size) OVER w - size AS z FROM d WINDOW w AS (PARTITION BY page_id ORDER BY i)),
    b AS (SELECT page_id, i, z, tag, row_number() OVER (PARTITION BY page_id ORDER BY i) AS n, lead(i) OVER (PARTITION BY page_id ORDER BY i) AS nxt FROM e WHERE step = 1 AND depth = 1)
    SELECT b.page_id, b.n, b.z::BIGINT AS first, b.tag, (SELECT sum(size) FROM e WHERE e.page_id = b.page_id AND e.i >= b.i AND (b.nxt IS NULL OR e.i < b.nxt) AND e.i <= coalesce((SELECT min(c.i) FROM e c WHERE c.page_id = b.page_id AND c.i > b.i AND c.depth <= 0 AND NOT (c.step = 1 AND c.depth = 1)), 1000000000))::BIGINT AS length FROM b""",
)
def _(spark, sf):
    return spans.top_level(t(spark, sf, "pages"), "page_id", "html")


@query("picture_elements", "SELECT p_partkey, '<image width=\"' || p_size || '\" href=\"data:image/png;base64,' || to_base64(encode(p_name)) || '\"/>' AS element, 100 * p_size // (100 - p_partkey % 50) AS cropped FROM part")
def _(spark, sf):
    shown = F.concat(F.lit('<image width="'), "p_size", F.lit('" href="data:image/png;base64,'), F.base64(F.col("p_name").cast("binary")), F.lit('"/>'))
    return t(spark, sf, "part").select("p_partkey", shown.alias("element"), F.expr("100 * p_size div (100 - p_partkey % 50)").alias("cropped"))


@query(
    "css_lengths",
    """
    SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN floor(p_size * 20 + 0.5) WHEN 1 THEN floor(p_size * 1440 + 0.5) WHEN 2 THEN floor((p_size / 2.0::DOUBLE) * (1440 / 2.54::DOUBLE) + 0.5) WHEN 3 THEN floor(p_size * 15 + 0.5) WHEN 4 THEN floor(p_size * 15 + 0.5) END::BIGINT AS twips FROM part""",
)
def _(spark, sf):
    value = F.expr("CASE p_partkey % 6 WHEN 0 THEN concat(p_size, 'pt') WHEN 1 THEN concat(p_size, 'in') WHEN 2 THEN concat(p_size / 2, 'cm') WHEN 3 THEN concat(p_size, 'px') WHEN 4 THEN CAST(p_size AS STRING) ELSE 'auto' END")
    return t(spark, sf, "part").select("p_partkey", style.css_twips(value).alias("twips"))


@query(
    "line_predicates",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, a % 40 <= 25 AND 2 * (a % 40) * (b % 9) <= 50 * (a % 12) AS compress, (coalesce(nullif(a % 4, 3), 0) = 0 OR b % 3 < a % 4) AND l_quantity > 18 AND (l_returnflag <> 'A' OR a % 2 = 0) AS hyphenate,
           a % 40 BETWEEN 10 AND 30 AS in_range FROM (SELECT *, l_partkey AS a, l_suppkey AS b FROM lineitem)""",
)
def _(spark, sf):
    a, b = F.col("l_partkey"), F.col("l_suppkey")
    limit = F.when(a % 4 != 3, a % 4)
    hyphenate = style.may_hyphenate(b % 3, limit, F.col("l_quantity"), F.lit(18), F.col("l_returnflag") == "A", a % 2 == 0)
    return t(spark, sf, "lineitem").select("l_orderkey", *_ITEMS, style.may_compress(a % 40, F.lit(25), b % 9, F.lit(50), a % 12).alias("compress"), hyphenate.alias("hyphenate"), (a % 40).between(10, 30).alias("in_range"))


@query("fixpoint_passes", "SELECT n_nationkey, greatest(n_nationkey, 20)::BIGINT AS v, 4 AS passes, true AS settled FROM nation")
def _(spark, sf):
    """Each pass moves values up by 7 as far as 20; the fourth changes nothing."""
    start = t(spark, sf, "nation").select("n_nationkey", F.col("n_nationkey").cast("long").alias("v"))
    found, passes, settled = layout.fixpoint(start, lambda d: d.select("n_nationkey", F.greatest("v", F.least(F.col("v") + 7, F.lit(20))).alias("v")))
    return found.withColumn("passes", F.lit(passes)).withColumn("settled", F.lit(settled))


@query("error_kinds", "SELECT event_id, CASE WHEN event_type <> 'error' THEN 'none' WHEN value < 10 THEN 'recoverable' WHEN user_id % 2 = 0 THEN 'named' ELSE 'control' END AS kind FROM events")
def _(spark, sf):
    kind = plan.first_reason([("none", F.col("event_type") != "error"), ("recoverable", F.col("value") < 10), ("named", F.col("user_id") % 2 == 0)], "control")
    return t(spark, sf, "events").select("event_id", kind.alias("kind"))


# --- notes at the foot, tables over pages, margins from stories


@query(
    "table_flow",
    r"""
    WITH w AS (SELECT conv_id, turn, [list_filter(string_split_regex(coalesce(role, ''), '[ \t\n\r\f\v]+'), lambda x: x <> ''), list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\r\f\v]+'), lambda x: x <> '')] AS cells FROM conversations),
    h AS (SELECT conv_id, turn, list_max(list_transform(range(1, 3), lambda i: list_reduce(list_prepend({l: 1::BIGINT, p: 0::BIGINT}, list_transform(cells[i], lambda x: {l: 0::BIGINT, p: length(x)::BIGINT})), lambda a, x:
            CASE WHEN a.p = 0 THEN {l: a.l, p: x.p} WHEN a.p + 1 + x.p <= CASE i WHEN 1 THEN 10 ELSE 40 END THEN {l: a.l, p: a.p + 1 + x.p} ELSE {l: a.l + 1, p: x.p} END).l)) AS h FROM w),
    i AS (SELECT conv_id, list({o: turn, h: h, f: turn = 0} ORDER BY turn) AS x FROM h GROUP BY 1),
    n AS (SELECT conv_id, x, CASE WHEN x[1].f THEN x[1].h ELSE 0 END AS heads, unnest(range(1, len(x) + 1)) AS n FROM i),
    r AS (SELECT conv_id, x[n].o AS turn, x[n].h AS height, list_reduce(list_prepend({h: 0::BIGINT, g: 1::BIGINT, u: -1::BIGINT}, list_transform(x[1:n], lambda v: {h: v.h, g: 0::BIGINT, u: 0::BIGINT})), lambda a, v:
        CASE WHEN a.u >= 0 AND a.u + v.h > 50 THEN {h: v.h, g: a.g + 1, u: CASE WHEN heads < 50 THEN heads ELSE 0 END + v.h} ELSE {h: v.h, g: a.g, u: greatest(a.u, 0) + v.h} END) AS s FROM n)
    SELECT conv_id, turn, height, s.g AS page FROM r""",
)
def _(spark, sf):
    """Cells wrapped in their columns, rows as high as their highest cell, rows on pages under a repeated header."""
    height = F.greatest(fold.wrapped(F.col("role"), 10)["lines"], fold.wrapped(F.col("text"), 40)["lines"])
    rows = t(spark, sf, "conversations").select("conv_id", "turn", height.alias("height"), (F.col("turn") == 0).alias("head"))
    return rows.select("conv_id", "turn", "height").join(layout.packed_rows(rows, "conv_id", "turn", "height", "head", 50), ["conv_id", "turn"])


@query("story_margins", "SELECT DISTINCT conv_id || '.docx' AS path, 2 AS lines, CASE WHEN conv_id % 7 = 0 THEN 720 ELSE greatest(conv_id % 7 * 200 - 100, 720 + 2 * 240) END AS margin FROM conversations")
def _(spark, sf):
    """The top margin pushed in by a header that is wrapped like any other text: 'Conversation', and its number on the next line."""
    rows = scanned(spark, sf, "story_reference", "relationship", "paragraph", "run")
    linked = rows.where("kind = 'relationship'").select("path", F.col("name").alias("value"), F.concat(F.lit("word/"), F.col("value")).alias("part"))
    used = rows.where("kind = 'story_reference'").select("path", "value").join(linked, ["path", "value"])
    parts = rows.where("kind = 'paragraph'").select("path", "part", "parent")
    text = paragraphs(rows).select("path", "parent", "text").join(parts, ["path", "parent"]).join(used, ["path", "part"])
    lines = text.groupBy("path").agg(F.sum(fold.wrapped(F.col("text"), 12)["lines"]).alias("lines"))
    k = F.regexp_extract("path", "^[0-9]+", 0).cast("long") % 7
    stated = F.when(k == 0, -720).otherwise(k * 200 - 100)
    return lines.select("path", "lines", table.text_box(stated, 720 + F.col("lines") * 240).alias("margin"))


# --- lines beside obstacles, layered records


@query(
    "wrapped_beside",
    """
    WITH f AS (SELECT doc_id, list_reduce(list_prepend({l: 1::BIGINT, p: 0::BIGINT}, list_transform(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> ''), lambda w: {l: 0::BIGINT, p: length(w)::BIGINT})), lambda a, w:
        CASE WHEN a.p = 0 THEN {l: a.l, p: w.p} WHEN a.p + 1 + w.p <= CASE WHEN a.l <= 3 THEN 30 WHEN a.l <= 5 THEN 50 ELSE 80 END THEN {l: a.l, p: a.p + 1 + w.p} ELSE {l: a.l + 1, p: w.p} END) AS r FROM documents)
    SELECT doc_id, r.l AS lines, r.p AS last_width FROM f""",
)
def _(spark, sf):
    """Three lines beside one obstacle, two beside a narrower one, the rest at full width."""
    w = fold.wrapped_beside(F.col("text"), F.array(*(F.lit(n) for n in (30, 30, 30, 50, 50))), 80)
    return t(spark, sf, "documents").select("doc_id", w.alias("r")).select("doc_id", F.col("r.lines").alias("lines"), F.col("r.pen").alias("last_width"))


@query(
    "outline_layers",
    """
    SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 30 END, CASE WHEN s_suppkey % 3 = 0 THEN 9 END, 1) AS width, coalesce(CASE WHEN s_suppkey % 5 = 0 THEN '' END, CASE WHEN s_suppkey % 3 = 0 THEN 'FF0000' END, '000000') AS colour,
           CASE WHEN s_suppkey % 2 = 0 THEN 'own' WHEN s_suppkey % 3 = 0 THEN 'style' ELSE 'default' END AS width_by FROM supplier""",
)
def _(spark, sf):
    k = F.col("s_suppkey")
    own, base = F.when(k % 2 == 0, k % 30), F.when(k % 3 == 0, 9)
    by = plan.first_reason([("own", own.isNotNull()), ("style", base.isNotNull())], "default")
    return t(spark, sf, "supplier").select("s_suppkey", style.stated(own, base, F.lit(1)).alias("width"), style.stated(F.when(k % 5 == 0, ""), F.when(k % 3 == 0, "FF0000"), F.lit("000000")).alias("colour"), by.alias("width_by"))


@query("first_defaults", "SELECT p_brand, p_size % 4 AS kind, arg_min(p_partkey, p_partkey) AS style, count(*) AS stated FROM part WHERE p_partkey % 3 > 0 GROUP BY 1, 2")
def _(spark, sf):
    return t(spark, sf, "part").where("p_partkey % 3 > 0").groupBy("p_brand", (F.col("p_size") % 4).alias("kind")).agg(F.min("p_partkey").alias("style"), F.count(F.lit(1)).alias("stated"))


@query("reason_texts", "SELECT event_id, 'layout-placeholder:' || event_type || ' at user ' || user_id || CASE WHEN value > 50 THEN ' (large)' ELSE '' END AS reason FROM events WHERE event_type IN ('error', 'click')")
def _(spark, sf):
    large = F.when(F.col("value") > 50, " (large)").otherwise("")
    return t(spark, sf, "events").where(F.col("event_type").isin("error", "click")).select("event_id", F.concat(F.lit("layout-placeholder:"), "event_type", F.lit(" at user "), "user_id", large).alias("reason"))


# --- cascades of tables, the flow of blocks, fixpoints after an edit


@query(
    "table_cascade",
    f"""
    WITH i AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ITEM}) AS n FROM lineitem)
    SELECT l_orderkey, n, coalesce(CASE WHEN l_partkey % 5 = 0 THEN l_partkey % 50 END, CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey % 20 END, CASE WHEN n % 2 = 0 THEN 7 END, l_orderkey % 9) AS padding,
           CASE WHEN l_partkey % 5 = 0 THEN 'cell' WHEN l_suppkey % 3 = 0 THEN 'row' WHEN n % 2 = 0 THEN 'band' ELSE 'table' END AS decided_by FROM i""",
)
def _(spark, sf):
    """A cell's padding: its own, its row's, its band's, its table's; each layer a row, the highest one decides."""
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ITEMS)).cast("long")
    i = dealt(t(spark, sf, "lineitem").select("l_orderkey", *_ITEMS), ["l_orderkey"]).select("l_orderkey", n.alias("n"), "l_partkey", "l_suppkey")
    layers = [("table", F.col("l_orderkey") % 9), ("band", F.when(F.col("n") % 2 == 0, 7)), ("row", F.when(F.col("l_suppkey") % 3 == 0, F.col("l_suppkey") % 20)), ("cell", F.when(F.col("l_partkey") % 5 == 0, F.col("l_partkey") % 50))]
    told = F.array(*(F.struct(F.lit(k).alias("rank"), F.lit(name).alias("origin"), value.cast("long").alias("value")) for k, (name, value) in enumerate(layers)))
    declared = i.select("l_orderkey", "n", F.inline(told)).withColumn("name", F.lit("padding"))
    found = resolve.cascade(declared, ["l_orderkey", "n"], "name", "value", "rank", "origin")
    return found.select("l_orderkey", "n", F.col("value").alias("padding"), F.col("origin").alias("decided_by"))


@query(
    "flow_of_blocks",
    r"""
    WITH w AS (SELECT conv_id, turn, role, coalesce(text, '') AS x, list_reduce(list_prepend({l: 1::BIGINT, p: 0::BIGINT}, list_transform(list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\r\f\v]+'), lambda w: w <> ''), lambda w: {l: 0::BIGINT, p: length(w)::BIGINT})),
            lambda a, w: CASE WHEN a.p = 0 THEN {l: a.l, p: w.p} WHEN a.p + 1 + w.p <= 60 THEN {l: a.l, p: a.p + 1 + w.p} ELSE {l: a.l + 1, p: w.p} END).l AS lines FROM conversations),
    f AS (SELECT *, count(*) FILTER (role = 'user') OVER o AS a, CASE WHEN first_value(role) OVER o = 'user' THEN 0 ELSE 1 END AS z, lag(role) OVER o AS before FROM w WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
    g AS (SELECT *, row_number() OVER (PARTITION BY conv_id, a ORDER BY turn) - CASE WHEN a > 0 THEN 1 ELSE 0 END AS b FROM f)
    SELECT conv_id, turn, CASE WHEN role = 'user' THEN (a + z) || '.' ELSE (a + z) || '.' || b || '.' END AS label, lines * 240 AS height, CASE WHEN before IS NULL OR before = role THEN 0 ELSE 120 END AS gap, role = 'user' AS keep_next,
           CASE WHEN lines > 25 THEN 'too long' WHEN x = '' THEN 'empty' END AS reason,
           sum(lines * 240 + CASE WHEN before IS NULL OR before = role THEN 0 ELSE 120 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS y_end FROM g""",
)
def _(spark, sf):
    """Label, height, space, keep and reason of every block, and where it ends."""
    user = F.col("role") == "user"
    blocks = t(spark, sf, "conversations").withColumn("x", F.coalesce("text", F.lit(""))).withColumn("lines", fold.wrapped(F.col("text"), 60)["lines"]).withColumn("level", F.when(user, 0).otherwise(1)).withColumn("instance", F.lit(1))
    levels = spark.sql("SELECT 1 AS instance, CAST(c1 AS INT) AS level, 'a' AS list, CAST(1 AS BIGINT) AS start, CAST(NULL AS BIGINT) AS restart, 'decimal' AS format, c2 AS text, false AS legal, false AS override FROM VALUES (0, '%1.'), (1, '%1.%2.') AS v(c1, c2)")
    rows = numbering.list_items(blocks, ["conv_id"], ["turn"], levels, depth=2)
    w = Window.partitionBy("conv_id").orderBy("turn")
    before = F.lag("role").over(w)
    rows = rows.withColumn("height", F.col("lines") * 240).withColumn("gap", F.when(before.isNull() | (before == F.col("role")), 0).otherwise(120))
    reason = plan.first_reason([("too long", F.col("lines") > 25), ("empty", F.col("x") == "")])
    return rows.select("conv_id", "turn", "label", "height", "gap", user.alias("keep_next"), reason.alias("reason"), F.sum(F.col("height") + F.col("gap")).over(w).alias("y_end"))


@query("fixpoint_after_edit", "SELECT n_nationkey, greatest(n_nationkey, 20)::BIGINT AS v, 2 AS passes, true AS settled FROM nation")
def _(spark, sf):
    """Settled values of the last version are kept where nothing changed; nations from 14 on begin anew and settle in one pass, the second changes nothing."""
    nation = t(spark, sf, "nation").select("n_nationkey")
    held = nation.where("n_nationkey < 14").select("n_nationkey", F.lit(20).cast("long").alias("v"))
    fresh = nation.where("n_nationkey >= 14").select("n_nationkey", F.col("n_nationkey").cast("long").alias("v"))
    found, passes, settled = layout.fixpoint(held.unionByName(fresh), lambda d: d.select("n_nationkey", F.greatest("v", F.least(F.col("v") + 7, F.lit(20))).alias("v")))
    return found.withColumn("passes", F.lit(passes)).withColumn("settled", F.lit(settled))
