"""Queries over the driver tables for the engine's operators, each with its SQL for a second engine."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strata.functions import numbers as num
from strata.operators import diff, fold, grid, joins, layout, resolve, sequence
from strata.plans.quality import coverage
from strata.plans.registry import ORACLE, QUERIES, query, t  # noqa: F401
from strata.sources import markup, svg
from strata.streaming.incremental import recompute

#: A total order of a line item within its order.
ITEM = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
_ITEM = ", ".join(ITEM)
_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')"


# --- numbers, text and units


@query(
    "format_numbers",
    """
    WITH n AS (SELECT p_partkey, p_partkey % 780 AS n FROM part),
    r AS (SELECT *, ['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'][n // 100 + 1]
             || ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][n // 10 % 10 + 1]
             || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][n % 10 + 1] AS rom FROM n)
    SELECT p_partkey, n::VARCHAR AS decimal, CASE WHEN n = 0 THEN ' ' ELSE rom END AS lower_roman,
           CASE WHEN n = 0 THEN ' ' ELSE repeat(chr((97 + (n - 1) % 26)::INT), ((n - 1) // 26 + 1)::INT) END AS lower_letter,
           '- ' || n || ' -' AS dash, CASE WHEN n < 10 THEN '0' || n ELSE n::VARCHAR END AS zero, upper(format('{:x}', n)) AS hex,
           CASE WHEN n > 0 THEN repeat(['*', '†', '‡', '§'][(n - 1) % 4 + 1], ((n - 1) // 4 + 1)::INT) END AS sign
    FROM r""",
)
def _(spark, sf):
    n = F.col("n")
    forms = {"decimal": "decimal", "lower_roman": "lowerRoman", "lower_letter": "lowerLetter", "dash": "numberInDash", "zero": "decimalZero", "hex": "hex", "sign": "chicago"}
    df = t(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 780).alias("n"))
    return df.select("p_partkey", *(num.number_text(n, F.lit(f)).alias(k) for k, f in forms.items()))


@query(
    "picture_format",
    """
    SELECT p_partkey, repeat('0', greatest(4 - length(p_size::VARCHAR), 0)) || p_size AS zeros,
           repeat(' ', greatest(3 - length(p_size::VARCHAR), 0)) || p_size AS spaces,
           left(' 00', greatest(3 - length(p_size::VARCHAR), 0)) || p_size AS mixed FROM part""",
)
def _(spark, sf):
    shapes = {"zeros": "0000", "spaces": "###", "mixed": "#00"}
    return t(spark, sf, "part").select("p_partkey", *(num.picture(F.col("p_size"), F.lit(s)).alias(k) for k, s in shapes.items()))


@query(
    "case_switches",
    """
    SELECT doc_id, upper(replace(w, 'ß', 'SS')) AS upper, lower(w) AS lower, upper(replace(w[1], 'ß', 'SS')) || w[2:] AS first_cap,
           array_to_string(list_transform(string_split(w, ' '), lambda x: upper(replace(x[1], 'ß', 'SS')) || x[2:]), ' ') AS caps
    FROM (SELECT doc_id, coalesce(text, '') AS w FROM documents)""",
)
def _(spark, sf):
    w = F.coalesce("text", F.lit(""))
    return t(spark, sf, "documents").select("doc_id", w.alias("w")).select("doc_id", F.upper("w").alias("upper"), F.lower("w").alias("lower"), num.first_cap(F.col("w")).alias("first_cap"), num.caps(F.col("w")).alias("caps"))


@query(
    "rounding_rules",
    """
    SELECT p_partkey, floor(q + 0.5)::BIGINT AS half_up, ceil(q - 0.5)::BIGINT AS half_down, round(q)::BIGINT AS half_away, round_even(q, 0)::BIGINT AS half_even
    FROM (SELECT p_partkey, (p_partkey * 7 - 5001) / 4.0::DOUBLE AS q FROM part)""",
)
def _(spark, sf):
    a = F.col("p_partkey") * 7 - 5001
    return t(spark, sf, "part").select("p_partkey", *(f(a, 4).alias(f.__name__) for f in (num.half_up, num.half_down, num.half_away, num.half_even)))


@query(
    "unit_conversions",
    """
    SELECT p_partkey, floor(p_partkey * 300 / 1440.0 + 0.5)::BIGINT AS px, floor((p_partkey * 1001 - 90000) / 635.0)::BIGINT AS twips,
           floor(p_size * CASE WHEN p_partkey % 3 = 0 THEN 3 ELSE 1 END * 2.5)::BIGINT AS border, floor(p_partkey / 4.0 + 0.5)::BIGINT AS quarter FROM part""",
)
def _(spark, sf):
    k = F.col("p_partkey")
    border = num.border_twips(F.col("p_size"), k % 3 == 0)
    return t(spark, sf, "part").select("p_partkey", num.twips_to_px(k).alias("px"), num.emu_to_twips(k * 1001 - 90000).alias("twips"), border.alias("border"), num.quarter(k).alias("quarter"))


@query(
    "switch_truth",
    """
    SELECT event_id, CASE WHEN event_type = 'error' THEN user_id % 2 = 0 WHEN event_type = 'view' THEN true
           ELSE (props->>'k') IN ('1', 'true', 'on') END AS truth FROM events""",
)
def _(spark, sf):
    kind = F.col("event_type")
    value = F.when(kind != "view", F.get_json_object("props", "$.k"))
    return t(spark, sf, "events").select("event_id", num.truth(kind != "error", value, F.col("user_id") % 2 == 0).alias("truth"))


@query(
    "instruction_parts",
    r"""
    SELECT event_id, upper(regexp_extract(i, '^\s*(\w+)', 1)) AS keyword, regexp_extract(i, '^\s*\w+\s+([^\s\\]+)', 1) AS argument,
           array_to_string(list_transform(regexp_extract_all(i, '\\([a-zA-Z*#])', 1), lambda x: x), ',') AS flags
    FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'seq fig' || user_id || ' \* roman \h' WHEN 'click' THEN 'PAGEREF b' || event_id || ' \h'
                           ELSE ' ref ' || event_type || ' \# 00 \* Upper' END AS i FROM events)""",
)
def _(spark, sf):
    i = F.expr(r"CASE event_type WHEN 'view' THEN concat('seq fig', user_id, ' \\* roman \\h') WHEN 'click' THEN concat('PAGEREF b', event_id, ' \\h') ELSE concat(' ref ', event_type, ' \\# 00 \\* Upper') END")
    flags = F.array_join(F.regexp_extract_all(F.col("i"), F.lit(r"\\([a-zA-Z*#])"), F.lit(1)), ",")
    df = t(spark, sf, "events").select("event_id", i.alias("i"))
    return df.select("event_id", F.upper(F.regexp_extract("i", r"^\s*(\w+)", 1)).alias("keyword"), F.regexp_extract("i", r"^\s*\w+\s+([^\s\\]+)", 1).alias("argument"), flags.alias("flags"))


@query(
    "char_classes",
    """
    SELECT doc_id, length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) AS ascii, length(regexp_replace(text, '[^\\x{80}-\\x{24F}]', '', 'g')) AS latin,
           length(regexp_replace(text, '[\\x00-\\x{24F}]', '', 'g')) AS other FROM documents""".replace("\\\\", "\\"),
)
def _(spark, sf):
    left = lambda cut: F.length(F.regexp_replace("text", cut, "")).cast("long")
    return t(spark, sf, "documents").select("doc_id", left("[^\\x00-\\x7F]").alias("ascii"), left("[^\\x{80}-\\x{24F}]").alias("latin"), left("[\\x00-\\x{24F}]").alias("other"))


# --- counters, islands and other windows


@query(
    "seq_counter_events",
    """
    WITH e AS (SELECT *, count(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS era FROM events)
    SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, era, event_type ORDER BY ts, event_id) AS value FROM e""",
)
def _(spark, sf):
    df = sequence.counter(t(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type", F.col("event_type") == "signup", F.lit(1))
    return df.select("event_id", "user_id", "event_type", "value")


@query(
    "set_counter_events",
    """
    WITH e AS (SELECT *, CASE WHEN event_type = 'purchase' THEN user_id % 50 END AS stated FROM events),
    g AS (SELECT *, count(stated) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS era FROM e)
    SELECT event_id, CASE WHEN era = 0 THEN row_number() OVER w ELSE first_value(stated) OVER w + row_number() OVER w - 1 END AS value
    FROM g WINDOW w AS (PARTITION BY user_id, era ORDER BY ts, event_id)""",
)
def _(spark, sf):
    df = t(spark, sf, "events").withColumn("stated", F.when(F.col("event_type") == "purchase", F.col("user_id") % 50))
    return sequence.set_counter(df, ["user_id"], ["ts", "event_id"], "stated", F.lit(1)).select("event_id", "value")


@query(
    "outline_numbers",
    """
    WITH n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS b FROM nation)
    SELECT c_custkey, (r_regionkey + 1) || '.' || b || '.' || row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) || '.' AS label
    FROM customer JOIN n ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def _(spark, sf):
    nation = t(spark, sf, "nation").withColumn("b", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")))
    region = t(spark, sf, "region").select("r_regionkey", (F.col("r_regionkey") + 1).alias("a"))
    df = t(spark, sf, "customer").join(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")), F.col("c_nationkey") == F.col("n_nationkey"))
    own = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    return df.select("c_custkey", F.concat_ws(".", "a", "b", own, F.lit("")).alias("label"))


@query(
    "line_numbers_every_5",
    """
    WITH n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS line FROM conversations)
    SELECT conv_id, turn, line, CASE WHEN line % 5 = 0 THEN line::VARCHAR ELSE '' END AS shown FROM n""",
)
def _(spark, sf):
    line = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long")
    df = t(spark, sf, "conversations").select("conv_id", "turn", line.alias("line"))
    return df.withColumn("shown", F.when(F.col("line") % 5 == 0, F.col("line").cast("string")).otherwise(""))


@query(
    "footnote_places",
    f"""
    SELECT l_orderkey, {_ITEM}, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ITEM}) AS in_document,
           row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY {_ITEM}) AS in_section,
           row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY {_ITEM}) AS in_page FROM lineitem""",
)
def _(spark, sf):
    return sequence.places(t(spark, sf, "lineitem"), ["l_orderkey"], ITEM, "l_returnflag", "l_linestatus").select("l_orderkey", *ITEM, "in_document", "in_section", "in_page")


@query(
    "styleref_before_else_after",
    """
    WITH p AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'purchase'),
    b AS (SELECT e.event_id, max_by(p.value, (p.ts, p.event_id)) AS v FROM events e JOIN p ON p.user_id = e.user_id AND (p.ts, p.event_id) < (e.ts, e.event_id) GROUP BY 1),
    a AS (SELECT e.event_id, min_by(p.value, (p.ts, p.event_id)) AS v FROM events e JOIN p ON p.user_id = e.user_id AND (p.ts, p.event_id) >= (e.ts, e.event_id) GROUP BY 1)
    SELECT event_id, coalesce(b.v, a.v) AS found FROM events LEFT JOIN b USING (event_id) LEFT JOIN a USING (event_id)""",
)
def _(spark, sf):
    value = F.when(F.col("event_type") == "purchase", F.col("value"))
    return sequence.as_of(t(spark, sf, "events"), ["user_id"], ["ts", "event_id"], value).select("event_id", "found")


@query(
    "story_reference",
    """
    WITH p AS (SELECT user_id, ts::DATE AS page, min_by(value, (ts, event_id)) FILTER (event_type = 'click') AS f, max_by(value, (ts, event_id)) FILTER (event_type = 'click') AS l FROM events GROUP BY 1, 2)
    SELECT user_id, page, coalesce(f, (SELECT max_by(q.l, q.page) FROM p q WHERE q.user_id = p.user_id AND q.page < p.page AND q.l IS NOT NULL),
           (SELECT min_by(q.f, q.page) FROM p q WHERE q.user_id = p.user_id AND q.page > p.page AND q.f IS NOT NULL)) AS found FROM p""",
)
def _(spark, sf):
    df = t(spark, sf, "events").withColumn("page", F.to_date("ts"))
    return sequence.as_of_page(df, ["user_id"], "page", ["ts", "event_id"], F.when(F.col("event_type") == "click", F.col("value")))


@query(
    "inherit_stories",
    """
    SELECT o_orderkey, o_orderpriority, last_value(CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END IGNORE NULLS) OVER (PARTITION BY o_orderpriority, o_custkey % 100 ORDER BY o_orderkey) AS value FROM orders""",
)
def _(spark, sf):
    df = t(spark, sf, "orders").withColumn("part", F.col("o_custkey") % 100).withColumn("stated", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")))
    return sequence.inherit(df, ["o_orderpriority", "part"], ["o_orderkey"], "stated").select("o_orderkey", "o_orderpriority", "value")


@query(
    "gap_collapse",
    f"""
    SELECT l_orderkey, {_ITEM}, greatest(b - coalesce(lag(a) OVER (PARTITION BY l_orderkey ORDER BY {_ITEM}), 0), 0) AS gap_before
    FROM (SELECT *, l_quantity::BIGINT AS b, l_partkey % 40 AS a FROM lineitem)""",
)
def _(spark, sf):
    df = t(spark, sf, "lineitem").withColumn("b", F.col("l_quantity").cast("long")).withColumn("a", F.col("l_partkey") % 40)
    return sequence.collapsed_gaps(df, ["l_orderkey"], ITEM, "b", "a").select("l_orderkey", *ITEM, "gap_before")


@query(
    "box_islands",
    """
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events)
    SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, g ORDER BY ts, event_id) = 1 AS top,
           row_number() OVER (PARTITION BY user_id, event_type, g ORDER BY ts DESC, event_id DESC) = 1 AS bottom,
           row_number() OVER (PARTITION BY user_id, event_type, g ORDER BY ts DESC, event_id DESC) > 1 AS between_ FROM r""",
)
def _(spark, sf):
    df = sequence.island_sides(t(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type"))
    return df.select("event_id", "top", "bottom", F.col("between").alias("between_"))


@query(
    "type_runs",
    """
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events)
    SELECT user_id, event_type, min(event_id) AS first_id, count(*) AS n FROM r GROUP BY user_id, event_type, g""",
)
def _(spark, sf):
    df = sequence.islands(t(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type"))
    return df.groupBy("user_id", "event_type", "island").agg(F.min("event_id").alias("first_id"), F.count(F.lit(1)).alias("n")).drop("island")


@query(
    "join_deleted_with_next",
    """
    WITH g AS (SELECT *, coalesce(count(*) FILTER (role <> 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block FROM conversations)
    SELECT conv_id, min(turn) AS "first", max(turn) AS "last", count(*) AS n, string_agg(coalesce(text, ''), '|' ORDER BY turn) AS text FROM g GROUP BY conv_id, block""",
)
def _(spark, sf):
    return sequence.merge_with_next(t(spark, sf, "conversations"), ["conv_id"], "turn", F.col("role") == "user", F.coalesce("text", F.lit("")), "|")


@query("following_value", "SELECT conv_id, turn, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations")
def _(spark, sf):
    return sequence.next_value(t(spark, sf, "conversations"), ["conv_id"], ["turn"], F.col("role")).select("conv_id", "turn", "next")


@query(
    "section_ids",
    """
    SELECT event_id, (SELECT count(*) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND (p.ts, p.event_id) < (e.ts, e.event_id)) AS section FROM events e""",
)
def _(spark, sf):
    return sequence.sections(t(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase").select("event_id", "section")


@query("run_offsets", "SELECT conv_id, turn, (sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) - length(text))::BIGINT AS start_at FROM conversations")
def _(spark, sf):
    return sequence.offsets(t(spark, sf, "conversations"), ["conv_id"], ["turn"], F.length("text")).select("conv_id", "turn", F.col("start_at").cast("long").alias("start_at"))


@query(
    "pct_share_floor",
    """
    WITH c AS (SELECT *, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS s, sum(p_size) OVER (PARTITION BY p_brand) AS a FROM part)
    SELECT p_partkey, ((1000 * s) // a - (1000 * (s - p_size)) // a)::BIGINT AS share FROM c""",
)
def _(spark, sf):
    return sequence.floored_shares(t(spark, sf, "part"), ["p_brand"], ["p_partkey"], "p_size", 1000).select("p_partkey", F.col("share").cast("long").alias("share"))


@query(
    "ordered_log",
    """
    SELECT user_id, event_type, min_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2""",
)
def _(spark, sf):
    return sequence.first_seen(t(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query(
    "leading_header_rows",
    f"""
    WITH n AS (SELECT *, row_number() OVER w AS i, min(CASE WHEN l_quantity >= 25 THEN NULL ELSE 1 END) OVER w AS stop FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {_ITEM}))
    SELECT l_orderkey, count(*) FILTER (stop IS NULL) AS header_rows FROM n GROUP BY 1""",
)
def _(spark, sf):
    df = sequence.leading_run(t(spark, sf, "lineitem"), ["l_orderkey"], ITEM, F.col("l_quantity") >= 25)
    return df.groupBy("l_orderkey").agg(F.count(F.when(F.col("leading"), 1)).alias("header_rows"))


@query(
    "note_split",
    f"""
    WITH s AS (SELECT *, sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY {_ITEM})::BIGINT AS cum FROM lineitem)
    SELECT l_orderkey, min(cum) FILTER (l_linestatus = 'F') AS least, coalesce(max(cum) FILTER (l_linestatus = 'F' AND cum <= 60), 0) AS fits,
           max(cum) - coalesce(max(cum) FILTER (l_linestatus = 'F' AND cum <= 60), 0) AS rest FROM s GROUP BY 1""",
)
def _(spark, sf):
    df = t(spark, sf, "lineitem").withColumn("q", F.col("l_quantity").cast("long"))
    return sequence.largest_fit(df, ["l_orderkey"], ITEM, "q", F.col("l_linestatus") == "F", 60)


@query(
    "next_tab",
    """
    SELECT e.event_id, coalesce(min(s.k), (floor(e.k / 20.0)::BIGINT + 1) * 20) AS stop
    FROM (SELECT event_id, user_id, (value * 10)::BIGINT % 500 AS k FROM (SELECT event_id, user_id, floor(value) AS value FROM events)) e
    LEFT JOIN (SELECT unnest([35, 72, 144, 300])::BIGINT AS k) s ON s.k > e.k GROUP BY e.event_id, e.k""",
)
def _(spark, sf):
    k = (F.floor("value") * 10).cast("long") % 500
    stops = F.array(*(F.lit(s).cast("long") for s in (35, 72, 144, 300)))
    df = t(spark, sf, "events").select("event_id", k.alias("k"))
    custom = F.array_min(F.filter(stops, lambda s: s > F.col("k")))
    return df.select("event_id", F.coalesce(custom, (num.floor_div(F.col("k"), 20) + 1) * 20).alias("stop"))


@query(
    "endnotes_relocated",
    """
    SELECT conv_id, turn, CASE WHEN role = 'user' THEN row_number() OVER (PARTITION BY conv_id, role = 'user' ORDER BY turn) END AS note,
           row_number() OVER (PARTITION BY conv_id ORDER BY role = 'user', turn) AS place FROM conversations""",
)
def _(spark, sf):
    df = t(spark, sf, "conversations").select("conv_id", "turn", (F.col("role") == "user").alias("note_row"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    body, notes = df.where(~F.col("note_row")), df.where("note_row").withColumn("note", F.row_number().over(w).cast("long"))
    bodies = body.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    moved = notes.join(bodies, "conv_id", "left").withColumn("place", F.coalesce("n", F.lit(0)) + F.col("note"))
    kept = body.withColumn("note", F.lit(None).cast("long")).withColumn("place", F.row_number().over(w).cast("long"))
    return kept.select("conv_id", "turn", "note", "place").unionByName(moved.select("conv_id", "turn", "note", "place"))


# --- joins


@query(
    "bookmark_first_wins",
    """
    WITH s AS (SELECT user_id, min(event_id) AS start_at FROM events WHERE event_type = 'signup' GROUP BY 1)
    SELECT user_id, start_at, (SELECT min(e.event_id) FROM events e WHERE e.user_id = s.user_id AND e.event_type = 'error' AND e.event_id >= start_at) AS end_at FROM s""",
)
def _(spark, sf):
    e = t(spark, sf, "events").select("user_id", "event_type", "event_id", F.lit("b").alias("name"))
    return joins.paired_marks(e.where("event_type = 'signup'"), e.where("event_type = 'error'"), ["user_id"], "name", "event_id").drop("name")


@query(
    "reference_text",
    """
    WITH m AS (SELECT conv_id, min(turn) FILTER (role = 'user') AS a, max(turn) AS b FROM conversations GROUP BY 1)
    SELECT c.conv_id, string_agg(coalesce(text, ''), ' ' ORDER BY turn) AS text FROM conversations c JOIN m ON c.conv_id = m.conv_id AND turn >= a AND turn < b GROUP BY 1""",
)
def _(spark, sf):
    c = t(spark, sf, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    marks = c.groupBy("conv_id").agg(F.min(F.when(F.col("role") == "user", F.col("turn"))).alias("start_at"), F.max("turn").alias("end_at"))
    return joins.text_between(marks, c, ["conv_id"], "turn", "text").select("conv_id", "text")


@query(
    "pageref_lookup",
    """
    SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'error' WHEN n_regionkey % 2 = 0 THEN o_custkey::VARCHAR ELSE '- ' || o_custkey || ' -' END AS shown
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
def _(spark, sf):
    target = t(spark, sf, "customer").join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    target = target.select("c_custkey", F.when(F.col("n_regionkey") % 2 == 0, "decimal").otherwise("numberInDash").alias("form"))
    df = t(spark, sf, "orders").join(target, F.col("o_custkey") == F.col("c_custkey"), "left")
    return df.select("o_orderkey", F.coalesce(num.number_text(F.col("o_custkey"), F.col("form")), F.lit("error")).alias("shown"))


@query(
    "font_fallback_chain",
    """
    SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 5000 THEN c_name END, CASE WHEN n_nationkey % 2 = 0 THEN n_name END, CASE WHEN r_regionkey <> 1 THEN r_name END) AS found,
           CASE WHEN c_acctbal > 5000 THEN 'installed' WHEN n_nationkey % 2 = 0 THEN 'substitute' WHEN r_regionkey <> 1 THEN 'default' ELSE 'missing' END AS found_by
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def _(spark, sf):
    nation = t(spark, sf, "nation").join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    df = t(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    tries = [("installed", F.when(F.col("c_acctbal") > 5000, F.col("c_name"))), ("substitute", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name"))), ("default", F.when(F.col("r_regionkey") != 1, F.col("r_name")))]
    return joins.first_answer(df, tries).select("c_custkey", "found", "found_by")


@query(
    "overlap_join",
    """
    WITH s AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS a, floor(epoch(ts))::BIGINT + 3600 + floor(value)::BIGINT * 60 AS b, event_type FROM events)
    SELECT x.event_id AS error_id, y.event_id AS click_id FROM s x JOIN s y ON x.user_id = y.user_id AND x.a < y.b AND y.a < x.b WHERE x.event_type = 'error' AND y.event_type = 'click'""",
)
def _(spark, sf):
    a = F.unix_seconds(F.col("ts").cast("timestamp"))
    s = t(spark, sf, "events").select("event_id", "user_id", "event_type", a.alias("a"), (a + 3600 + F.floor("value") * 60).alias("b"))
    x = s.where("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), "a", "b")
    y = s.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("a").alias("c"), F.col("b").alias("d"))
    return joins.overlaps(x, y, ["user_id"], ("a", "b"), ("c", "d"), 7200).select("error_id", "click_id")


@query(
    "block_ancestors",
    """
    WITH s AS (SELECT page_id, list_filter(string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS p FROM pages)
    SELECT page_id, (i - 1)::INT AS level, array_to_string(p[1:i], '/') AS prefix FROM (SELECT page_id, p, unnest(range(1, len(p) + 1)) AS i FROM s)""",
)
def _(spark, sf):
    path = F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1)
    return joins.ancestors(t(spark, sf, "pages").select("page_id", path.alias("p")), F.col("p")).select("page_id", "level", "prefix")


@query(
    "line_of_offset",
    """
    WITH l AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS line FROM conversations),
    p AS (SELECT conv_id, turn, turn * 97 + 13 AS at FROM conversations)
    SELECT p.conv_id, p.turn, (SELECT max(line) FROM l WHERE l.conv_id = p.conv_id AND l.s <= p.at) AS line FROM p""",
)
def _(spark, sf):
    c = t(spark, sf, "conversations")
    lines = sequence.offsets(c, ["conv_id"], ["turn"], F.length("text")).withColumn("line", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    at = c.select("conv_id", "turn", (F.col("turn") * 97 + 13).alias("at"))
    return joins.number_of(at, lines.select("conv_id", "start_at", "line"), ["conv_id"], "at", "start_at").select("conv_id", "turn", "line")


@query(
    "pages_of_blocks",
    """
    SELECT l_partkey, count(*) AS pages, string_agg(l_suppkey::VARCHAR, ',' ORDER BY l_suppkey) AS suppliers FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) GROUP BY 1""",
)
def _(spark, sf):
    pairs = t(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
    keys = F.sort_array(F.collect_list("l_suppkey"))
    return pairs.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("pages"), F.array_join(keys.cast("array<string>"), ",").alias("suppliers"))


@query(
    "story_kind",
    """
    SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 AND o_orderkey % 7 = 0 THEN 'first' WHEN o_custkey % 2 = 0 AND o_orderkey % 2 = 0 THEN 'even' ELSE 'default' END AS kind FROM orders""",
)
def _(spark, sf):
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    return t(spark, sf, "orders").select("o_orderkey", joins.pick_story(c % 3 == 0, o % 7 == 0, o % 2 == 0, c % 2 == 0).alias("kind"))


@query(
    "missing_targets",
    """
    SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
)
def _(spark, sf):
    return t(spark, sf, "documents").select("doc_id").join(t(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


# --- aggregates


@query(
    "separate_maxima",
    """
    SELECT l_orderkey, max(l_quantity)::BIGINT AS ascent, coalesce(max(l_partkey % 30) FILTER (l_returnflag <> 'N'), 0) AS descent,
           count(DISTINCT l_linestatus) > 1 AS mixed FROM lineitem GROUP BY 1""",
)
def _(spark, sf):
    label = F.col("l_returnflag") == "N"
    return t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_quantity").cast("long").alias("ascent"), F.coalesce(F.max(F.when(~label, F.col("l_partkey") % 30)), F.lit(0)).alias("descent"), (F.count_distinct("l_linestatus") > 1).alias("mixed"))


@query(
    "col_min_max",
    """
    SELECT lang, max(list_max(list_transform(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: length(w))))::INT AS narrowest,
           max(list_max(list_transform(string_split(text, chr(10)), lambda w: length(w))))::INT AS widest FROM documents GROUP BY 1""",
)
def _(spark, sf):
    return grid.extents(t(spark, sf, "documents"), ["lang"], "text")


@query(
    "row_heights",
    """
    SELECT l_orderkey, CASE WHEN l_orderkey % 3 = 0 THEN greatest(max(l_quantity)::BIGINT, 20) WHEN l_orderkey % 3 = 1 THEN 30 - 2 ELSE max(l_quantity)::BIGINT END AS height FROM lineitem GROUP BY 1""",
)
def _(spark, sf):
    tallest, rule = F.max("l_quantity").cast("long"), F.col("l_orderkey") % 3
    df = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(tallest.alias("h"))
    return df.select("l_orderkey", F.when(rule == 0, F.greatest("h", F.lit(20))).when(rule == 1, F.lit(28)).otherwise(F.col("h")).cast("long").alias("height"))


@query(
    "edge_winner",
    f"""
    WITH b AS (SELECT *, CASE l_returnflag WHEN 'N' THEN 'nil' WHEN 'R' THEN 'double' ELSE 'single' END AS s, l_partkey % 12 AS w FROM lineitem),
    n AS (SELECT *, lead(s) OVER v AS s2, lead(w) OVER v AS w2 FROM b WINDOW v AS (PARTITION BY l_orderkey ORDER BY {_ITEM})),
    x AS (SELECT *, CASE s WHEN 'nil' THEN -1 WHEN 'double' THEN 3 * w ELSE w END AS e1, CASE WHEN s2 IS NULL OR s2 = 'nil' THEN -1 WHEN s2 = 'double' THEN 3 * w2 ELSE w2 END AS e2 FROM n)
    SELECT l_orderkey, {_ITEM}, CASE WHEN e2 > e1 THEN s2 ELSE s END AS edge_style, greatest(e1, e2, 0) AS edge_width FROM x""",
)
def _(spark, sf):
    style = F.when(F.col("l_returnflag") == "N", "nil").when(F.col("l_returnflag") == "R", "double").otherwise("single")
    w = Window.partitionBy("l_orderkey").orderBy(*ITEM)
    df = t(spark, sf, "lineitem").withColumn("s", style).withColumn("w", F.col("l_partkey") % 12)
    df = df.withColumn("s2", F.lead("s").over(w)).withColumn("w2", F.lead("w").over(w))
    return grid.edge_winner(df, (F.col("s"), F.col("w")), (F.col("s2"), F.col("w2"))).select("l_orderkey", *ITEM, "edge_style", "edge_width")


@query(
    "coverage_status",
    """
    WITH b AS (SELECT source, n_chars > 5000 AS s, lang <> 'en' AS a, l.doc_id IS NULL AS m FROM documents d LEFT JOIN labels l USING (doc_id))
    SELECT source, count(*) AS blocks, count(*) FILTER (NOT s) AS laid_out, count(*) FILTER (a) AS approximations, count(*) FILTER (m) AS missing,
           CASE WHEN bool_or(s) THEN 'partial' WHEN bool_or(a) OR bool_or(m) THEN 'approximate' ELSE 'complete' END AS status FROM b GROUP BY 1""",
)
def _(spark, sf):
    labels = t(spark, sf, "labels").select("doc_id", F.lit(1).alias("known"))
    df = t(spark, sf, "documents").join(labels, "doc_id", "left")
    return coverage(df, ["source"], F.col("n_chars") > 5000, F.col("lang") != "en", F.col("known").isNull())


@query(
    "bounding_boxes",
    """
    SELECT user_id, round(min(value) * 100)::BIGINT AS left_, round(max(value) * 100)::BIGINT AS right_, min(event_id) AS top, max(event_id) AS bottom FROM events GROUP BY 1""",
)
def _(spark, sf):
    cents = lambda v: F.round(v * 100).cast("long")
    return t(spark, sf, "events").groupBy("user_id").agg(cents(F.min("value")).alias("left_"), cents(F.max("value")).alias("right_"), F.min("event_id").alias("top"), F.max("event_id").alias("bottom"))


@query(
    "glyph_dictionary",
    f"""
    WITH w AS (SELECT DISTINCT unnest({_WORDS}) AS word FROM documents)
    SELECT word, md5(word) AS glyph FROM w""",
)
def _(spark, sf):
    words = F.filter(F.split(F.coalesce("text", F.lit("")), fold.WORDS), lambda w: w != "")
    return t(spark, sf, "documents").select(F.explode(words).alias("word")).distinct().withColumn("glyph", F.md5("word"))


# --- layered properties


@query(
    "cascade_value",
    """
    WITH d AS (SELECT c_custkey, 'size' AS name, r_name AS v, 1 AS rank, 'region' AS origin FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT c_custkey, 'size', CASE WHEN n_nationkey % 2 = 0 THEN n_name END, 2, 'nation' FROM customer JOIN nation ON c_nationkey = n_nationkey
        UNION ALL SELECT c_custkey, 'size', CASE WHEN c_acctbal < 0 THEN c_mktsegment END, 3, 'direct' FROM customer)
    SELECT c_custkey, name, arg_max(v, rank) FILTER (v IS NOT NULL) AS v, arg_max(origin, rank) FILTER (v IS NOT NULL) AS origin, count(v) AS levels FROM d GROUP BY 1, 2""",
)
def _(spark, sf):
    nation = t(spark, sf, "nation").join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    df = t(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    levels = [("region", F.col("r_name")), ("nation", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name"))), ("direct", F.when(F.col("c_acctbal") < 0, F.col("c_mktsegment")))]
    stated = F.array(*(F.struct(v.alias("v"), F.lit(k + 1).alias("rank"), F.lit(o).alias("origin")) for k, (o, v) in enumerate(levels)))
    declared = df.select("c_custkey", F.lit("size").alias("name"), F.inline(stated))
    return resolve.cascade(declared, ["c_custkey"], "name", "v", "rank", "origin")


@query(
    "toggle_xor",
    """
    WITH l AS (SELECT o_orderkey, o_orderkey % 2 = 0 AS base, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 3 = 1 END AS a, CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 3 = 1 END AS b,
               CASE WHEN o_orderkey % 11 = 0 THEN o_custkey % 2 = 0 END AS direct FROM orders)
    SELECT o_orderkey, coalesce(direct, base <> (((CASE WHEN a <> base THEN 1 ELSE 0 END) + (CASE WHEN b <> base THEN 1 ELSE 0 END)) % 2 = 1)) AS bold FROM l""",
)
def _(spark, sf):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    levels = [F.when(x % 3 > 0, x % 3 == 1) for x in (o, c)]
    return t(spark, sf, "orders").select("o_orderkey", resolve.toggled(o % 2 == 0, levels, F.when(o % 11 == 0, c % 2 == 0)).alias("bold"))


@query(
    "style_chain_depth",
    """
    WITH RECURSIVE n AS (SELECT p_partkey AS id, CASE WHEN p_partkey >= 10 THEN p_partkey // 10 END AS parent, p_size % 2 AS kind FROM part),
    c AS (SELECT id, id AS ancestor, parent, kind, 0 AS depth FROM n UNION ALL SELECT c.id, n.id, n.parent, c.kind, depth + 1 FROM c JOIN n ON c.parent = n.id AND c.kind = n.kind)
    SELECT id, max(depth) AS depth, arg_max(ancestor, depth) AS root FROM c GROUP BY 1""",
)
def _(spark, sf):
    nodes = t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.expr("CASE WHEN p_partkey >= 10 THEN p_partkey div 10 END").alias("parent"), (F.col("p_size") % 2).alias("kind"))
    return resolve.chains(nodes, "id", "parent", "kind").groupBy("id").agg(F.max("depth").alias("depth"), F.max_by("ancestor", "depth").alias("root"))


@query(
    "tab_stop_merge",
    f"""
    WITH s AS (SELECT l_orderkey, l_partkey % 6 AS stop, CASE l_returnflag WHEN 'N' THEN 'clear' WHEN 'A' THEN 'left' ELSE 'right' END AS kind, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ITEM}) AS r FROM lineitem)
    SELECT l_orderkey, stop, arg_max(kind, r) AS kind FROM s GROUP BY 1, 2 HAVING arg_max(kind, r) <> 'clear'""",
)
def _(spark, sf):
    kind = F.when(F.col("l_returnflag") == "N", "clear").when(F.col("l_returnflag") == "A", "left").otherwise("right")
    df = t(spark, sf, "lineitem").select("l_orderkey", (F.col("l_partkey") % 6).alias("stop"), kind.alias("kind"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ITEM)).alias("r"))
    return resolve.merged_stops(df, ["l_orderkey"], "stop", "kind", "r")


@query(
    "band_classes",
    """
    WITH g AS (SELECT s_suppkey, (s_suppkey - 1) // 10 AS r, (s_suppkey - 1) % 10 AS c, (SELECT (max(s_suppkey) + 9) // 10 FROM supplier) AS n FROM supplier)
    SELECT s_suppkey, concat_ws(' ', 'whole', CASE WHEN c BETWEEN 1 AND 8 THEN CASE WHEN c % 2 = 1 THEN 'band1Vert' ELSE 'band2Vert' END END,
        CASE WHEN r > 0 AND r < n - 1 THEN CASE WHEN r % 2 = 1 THEN 'band1Horz' ELSE 'band2Horz' END END,
        CASE WHEN c = 0 THEN 'firstCol' END, CASE WHEN c = 9 THEN 'lastCol' END, CASE WHEN r = 0 THEN 'firstRow' END, CASE WHEN r = n - 1 THEN 'lastRow' END,
        CASE WHEN r = 0 AND c = 0 THEN 'nwCell' END, CASE WHEN r = 0 AND c = 9 THEN 'neCell' END, CASE WHEN r = n - 1 AND c = 0 THEN 'swCell' END, CASE WHEN r = n - 1 AND c = 9 THEN 'seCell' END) AS formats FROM g""",
)
def _(spark, sf):
    s = t(spark, sf, "supplier").select("s_suppkey")
    size = s.agg(F.expr("(max(s_suppkey) + 9) div 10").alias("n"))
    df = s.join(F.broadcast(size)).withColumn("r", F.expr("(s_suppkey - 1) div 10")).withColumn("c", F.expr("(s_suppkey - 1) % 10"))
    return df.select("s_suppkey", resolve.bands(F.col("r"), F.col("c"), F.col("n"), F.lit(10)).alias("formats"))


@query("resolve_distinct", "SELECT o_orderkey, lower(o_orderpriority) || '/' || o_orderstatus AS resolved FROM orders")
def _(spark, sf):
    df = t(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return resolve.resolve_distinct(df, ["o_orderpriority", "o_orderstatus"], F.concat(F.lower("o_orderpriority"), F.lit("/"), "o_orderstatus"), "resolved").select("o_orderkey", "resolved")


# --- grids and intervals


@query(
    "free_spans",
    """
    WITH s AS (SELECT user_id, floor(epoch(ts))::BIGINT AS a, floor(epoch(ts))::BIGINT + 3600 AS b FROM events),
    r AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s)
    SELECT user_id, m AS free_from, a AS free_to FROM r WHERE a - m >= 360""",
)
def _(spark, sf):
    a = F.unix_seconds(F.col("ts").cast("timestamp"))
    return grid.free_spans(t(spark, sf, "events").select("user_id", a.alias("a"), (a + 3600).alias("b")), ["user_id"], "a", "b", 360)


@query(
    "merged_spans",
    """
    WITH s AS (SELECT user_id, floor(epoch(ts))::BIGINT AS a, floor(epoch(ts))::BIGINT + 86400 AS b FROM events),
    r AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM s),
    g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM r)
    SELECT user_id, min(a) AS a, max(b) AS b, count(*) AS members FROM g GROUP BY user_id, k""",
)
def _(spark, sf):
    a = F.unix_seconds(F.col("ts").cast("timestamp"))
    return grid.merged_spans(t(spark, sf, "events").select("user_id", a.alias("a"), (a + 86400).alias("b")), ["user_id"], "a", "b")


@query(
    "autofit_widths",
    """
    WITH c AS (SELECT p_brand, p_type, max(p_size)::BIGINT AS narrowest, (max(p_size) + count(*))::BIGINT AS widest, CASE WHEN max(p_partkey) % 3 = 0 THEN min(p_size)::BIGINT END AS stated FROM part GROUP BY 1, 2),
    w AS (SELECT *, greatest(coalesce(stated, widest), narrowest) AS want FROM c),
    s AS (SELECT *, sum(want) OVER b AS wants, sum(narrowest) OVER b AS least FROM w WINDOW b AS (PARTITION BY p_brand)),
    p AS (SELECT *, CASE WHEN wants > 280 AND least <= 280 THEN want - narrowest ELSE narrowest END AS part, CASE WHEN least <= 280 THEN 280 - least ELSE 280 END AS pool FROM s),
    e AS (SELECT *, sum(part) OVER (PARTITION BY p_brand) AS parts, sum(part) OVER (PARTITION BY p_brand ORDER BY p_type) AS upto FROM p),
    h AS (SELECT *, (pool * upto) // parts - (pool * (upto - part)) // parts AS share FROM e)
    SELECT p_brand, p_type, (CASE WHEN wants <= 280 THEN want WHEN least <= 280 THEN narrowest + coalesce(share, 0) ELSE share END)::BIGINT AS width FROM h""",
)
def _(spark, sf):
    stated = F.when(F.max("p_partkey") % 3 == 0, F.min("p_size").cast("long"))
    cols = t(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.max("p_size").cast("long").alias("narrowest"), (F.max("p_size") + F.count(F.lit(1))).cast("long").alias("widest"), stated.alias("stated"))
    return grid.content_widths(cols, ["p_brand"], "p_type", "narrowest", "widest", "stated", 280).select("p_brand", "p_type", F.col("width").cast("long").alias("width"))


@query("equal_columns", "SELECT p_partkey, (p_retailprice::BIGINT - 36 * (p_size % 4)) // (p_size % 4 + 1) AS width FROM (SELECT p_partkey, p_size, floor(p_retailprice) AS p_retailprice FROM part)")
def _(spark, sf):
    return t(spark, sf, "part").select("p_partkey", grid.equal_columns(F.floor("p_retailprice"), F.lit(36), F.col("p_size") % 4 + 1).alias("width"))


# --- folds


@query(
    "wrap_documents",
    f"""
    WITH f AS (SELECT doc_id, list_reduce(list_prepend({{l: 1::BIGINT, p: 0::BIGINT}}, list_transform({_WORDS}, lambda w: {{l: 0::BIGINT, p: length(w)::BIGINT}})),
        lambda a, w: CASE WHEN a.p = 0 THEN {{l: a.l, p: w.p}} WHEN a.p + 1 + w.p <= 80 THEN {{l: a.l, p: a.p + 1 + w.p}} ELSE {{l: a.l + 1, p: w.p}} END) AS r FROM documents)
    SELECT doc_id, r.l AS lines, r.p AS last_width, (r.l - 1) // 50 + 1 AS pages FROM f""",
)
def wrap_documents(spark, sf):
    df = t(spark, sf, "documents").select("doc_id", fold.wrapped(F.col("text"), 80).alias("r"))
    return df.select("doc_id", F.col("r.lines").alias("lines"), F.col("r.pen").alias("last_width"), F.expr("(r.lines - 1) div 50 + 1").alias("pages"))


@query(
    "pack_orders_into_pages",
    f"""
    WITH i AS (SELECT l_orderkey, list(l_quantity::BIGINT ORDER BY {_ITEM}) AS q FROM lineitem GROUP BY 1),
    f AS (SELECT l_orderkey, list_reduce(list_prepend({{g: 1::BIGINT, f: 0::BIGINT}}, list_transform(q, lambda x: {{g: 0::BIGINT, f: x}})),
        lambda a, x: CASE WHEN a.f = 0 OR a.f + x.f <= 60 THEN {{g: a.g, f: a.f + x.f}} ELSE {{g: a.g + 1, f: x.f}} END) AS r FROM i)
    SELECT l_orderkey, r.g AS pages, r.f AS last_fill FROM f""",
)
def _(spark, sf):
    return fold.packed(t(spark, sf, "lineitem"), ["l_orderkey"], ITEM, "l_quantity", 60)


@query(
    "paginate_full",
    """
    WITH RECURSIVE p AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ps FROM documents),
    l AS (SELECT doc_id, i - 1 AS block, list_reduce(list_prepend({l: 1::BIGINT, p: 0::BIGINT}, list_transform(list_filter(string_split_regex(ps[i], '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> ''), lambda w: {l: 0::BIGINT, p: length(w)::BIGINT})),
            lambda a, w: CASE WHEN a.p = 0 THEN {l: a.l, p: w.p} WHEN a.p + 1 + w.p <= 80 THEN {l: a.l, p: a.p + 1 + w.p} ELSE {l: a.l + 1, p: w.p} END).l AS n
          FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM p)),
    c AS (SELECT *, block % 5 = 4 AS kl, block % 40 = 39 AS br, coalesce(max(CASE WHEN block % 7 > 0 THEN block + 1 END) OVER (PARTITION BY doc_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chain FROM l),
    s(doc_id, step, pos, line, page, used, top, eb, el, en, ep, back) AS (
        SELECT doc_id, 0, 0::BIGINT, 0::BIGINT, 1::BIGINT, 0::BIGINT, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM p
        UNION ALL
        SELECT doc_id, step + 1,
               CASE kind WHEN 'whole' THEN pos + 1 WHEN 'move' THEN mv ELSE pos + (line + m >= n)::INT END,
               CASE WHEN kind = 'cut' AND line + m < n THEN line + m WHEN kind = 'move' AND mv = pos THEN line ELSE 0 END,
               CASE kind WHEN 'whole' THEN page ELSE page + 1 END, CASE kind WHEN 'whole' THEN used + rest ELSE 0 END,
               CASE kind WHEN 'whole' THEN top WHEN 'move' THEN mv ELSE pos + (line + m >= n)::INT END,
               CASE WHEN kind = 'cut' OR (kind = 'whole' AND rest > 0) THEN pos END, line, CASE kind WHEN 'whole' THEN rest ELSE m END, page, CASE WHEN kind = 'move' AND mv < pos THEN mv END
        FROM (SELECT *, CASE WHEN used + rest <= 50 THEN 'whole' WHEN k <= 0 AND used > 0 THEN 'move' ELSE 'cut' END AS kind, greatest(1, least(CASE WHEN k > 0 THEN k ELSE 50 END, rest, 50)) AS m,
                     CASE WHEN line = 0 AND greatest(chain, top) > top AND greatest(chain, top) < pos THEN greatest(chain, top) ELSE pos END AS mv
              FROM (SELECT *, CASE WHEN line = 0 AND j > 0 AND j < 2 THEN 0 ELSE j END AS k
                    FROM (SELECT *, CASE WHEN kl AND line = 0 AND used > 0 THEN 0 WHEN rest - (50 - used) < 2 THEN greatest(0, rest - 2) ELSE 50 - used END AS j
                          FROM (SELECT s.doc_id, step, pos, line, c.n, kl, chain, c.n - line AS rest, page + b AS page, CASE WHEN b = 1 THEN 0 ELSE used END AS used, CASE WHEN b = 1 THEN pos ELSE top END AS top
                                FROM (SELECT s.*, (c.br AND line = 0 AND used > 0)::INT AS b FROM s JOIN c ON c.doc_id = s.doc_id AND c.block = s.pos) s JOIN c ON c.doc_id = s.doc_id AND c.block = s.pos)))))
    SELECT doc_id, eb AS block, el AS first_line, en AS lines, ep AS page FROM s
    WHERE eb IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s t WHERE t.doc_id = s.doc_id AND t.step > s.step AND s.eb >= t.back AND t.back IS NOT NULL)""",
)
def _(spark, sf):
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda p: fold.wrapped(p, 80)["lines"])
    told = F.transform(lines, lambda n, k: F.struct(k.cast("long").alias("block"), n.alias("lines"), (k % 5 == 4).alias("keep_lines"), (k % 7 == 0).alias("keep_next"), (k % 40 == 39).alias("break_before")))
    return fold.paginate_rows(t(spark, sf, "documents").select("doc_id", told.alias("blocks")), 50)


@query(
    "balanced_columns",
    f"""
    WITH i AS (SELECT l_orderkey, list(l_quantity::BIGINT ORDER BY {_ITEM}) AS q FROM lineitem GROUP BY 1),
    h AS (SELECT l_orderkey, q, unnest(range(list_max(q), list_sum(q)::BIGINT + 1)) AS h FROM i),
    f AS (SELECT l_orderkey, h, list_reduce(list_prepend({{g: 1::BIGINT, f: 0::BIGINT}}, list_transform(q, lambda x: {{g: h, f: x}})),
        lambda a, x: CASE WHEN a.f + x.f <= x.g THEN {{g: a.g, f: a.f + x.f}} ELSE {{g: a.g + 1, f: x.f}} END) AS r FROM h)
    SELECT l_orderkey, min(h) AS height FROM f WHERE r.g <= 2 GROUP BY 1""",
)
def _(spark, sf):
    return fold.balanced_height(t(spark, sf, "lineitem"), ["l_orderkey"], ITEM, "l_quantity", 2)


# --- differences


@query(
    "digest_diff",
    """
    WITH o AS (SELECT doc_id, md5(coalesce(text, '')) AS d FROM documents WHERE doc_id % 10 <> 3), n AS (SELECT doc_id, md5(CASE WHEN doc_id % 7 = 0 THEN text || '.' ELSE coalesce(text, '') END) AS d FROM documents WHERE doc_id % 10 <> 5)
    SELECT doc_id, CASE WHEN o.d IS NULL THEN 'added' WHEN n.d IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n USING (doc_id) WHERE o.d IS DISTINCT FROM n.d""",
)
def _(spark, sf):
    d = t(spark, sf, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    old = d.where("doc_id % 10 <> 3").select("doc_id", F.md5("text").alias("d"))
    new = d.where("doc_id % 10 <> 5").select("doc_id", F.md5(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))).alias("d"))
    return diff.keyed_diff(old, new, "doc_id", "d")


@query(
    "changed_windows",
    """
    WITH c AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, event_type FROM events),
    w AS (SELECT user_id, greatest(i - 1, 0) AS lo, i + 1 AS hi FROM c WHERE event_type = 'error'),
    m AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS n FROM w),
    g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS k FROM m)
    SELECT user_id, min(lo) AS "first", max(hi) AS "last" FROM g GROUP BY user_id, k""",
)
def _(spark, sf):
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    df = t(spark, sf, "events").select("user_id", i.cast("long").alias("i"), "event_type").where("event_type = 'error'")
    return diff.changed_windows(df, ["user_id"], "i")


@query(
    "common_prefix_suffix",
    """
    WITH c AS (SELECT conv_id, turn, md5(text) AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
    o AS (SELECT conv_id, list(a ORDER BY i) AS x FROM c GROUP BY 1), n AS (SELECT conv_id, list(CASE WHEN (conv_id + i) % 5 = 4 THEN 'new' ELSE a END ORDER BY i) AS y FROM c GROUP BY 1),
    j AS (SELECT conv_id, x, y, len(x)::BIGINT AS m FROM o JOIN n USING (conv_id)),
    p AS (SELECT *, coalesce(list_min(list_filter(range(0, m), lambda k: x[k + 1] <> y[k + 1])), m) AS prefix, coalesce(list_min(list_filter(range(0, m), lambda k: x[m - k] <> y[m - k])), m) AS s FROM j)
    SELECT conv_id, prefix, least(s, m - prefix) AS suffix FROM p""",
)
def _(spark, sf):
    i = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    old = t(spark, sf, "conversations").select("conv_id", i.cast("long").alias("i"), F.md5("text").alias("d"))
    new = old.withColumn("d", F.when((F.col("conv_id") + F.col("i")) % 5 == 4, "new").otherwise(F.col("d")))
    return diff.common_ends(old, new, ["conv_id"], "i", "d")


@query("renumber_after_insert", "SELECT doc_id, CASE WHEN doc_id >= 100 THEN doc_id + 3 ELSE doc_id END AS ordinal FROM documents")
def _(spark, sf):
    df = t(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("ordinal"))
    return diff.shifted(df, "ordinal", 100, 3)


@query("incremental_equals_full", "SELECT doc_id, length(text) - length(replace(text, ' ', '')) AS spaces, doc_id % 9 <> 0 OR text IN (SELECT text FROM documents WHERE doc_id % 9 <> 0) AS reused FROM documents")
def _(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    compute = lambda df: df.withColumn("spaces", (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).cast("long"))
    before = recompute(d.where("doc_id % 9 <> 0"), None, "doc_id", ["text"], compute)
    return recompute(d, before, "doc_id", ["text"], compute).select("doc_id", "spaces", "reused")


# --- scans and sinks


@query(
    "html_tag_counts",
    """
    SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, lower(unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM pages) GROUP BY 1, 2""",
)
def _(spark, sf):
    return markup.tag_counts(t(spark, sf, "pages"), "page_id", "html")


@query("html_links", """SELECT page_id, len(regexp_extract_all(html, 'href="([^"]*)"', 1))::INT AS n, array_to_string(regexp_extract_all(html, 'href="([^"]*)"', 1), ' ') AS targets FROM pages""")
def _(spark, sf):
    found = markup.links(F.col("html"))
    return t(spark, sf, "pages").select("page_id", F.size(found).alias("n"), F.array_join(found, " ").alias("targets"))


@query(
    "html_plain_text",
    r"""
    WITH b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g') AS h FROM pages)
    SELECT page_id, md5(trim(regexp_replace(regexp_replace(h, '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g'))) AS digest FROM b""",
)
def _(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.md5(markup.plain_text(F.col("html"))).alias("digest"))


@query(
    "page_selection",
    """
    SELECT o_orderkey, pos - 1 AS pos, p::INT AS page FROM (SELECT o_orderkey, unnest(list_concat([3], list_concat(range(5, 6 + o_orderkey % 3), [1]))) AS p, generate_subscripts(list_concat([3], list_concat(range(5, 6 + o_orderkey % 3), [1])), 1) AS pos FROM orders)""",
)
def _(spark, sf):
    text = F.concat(F.lit("3, 5-"), F.col("o_orderkey") % 3 + 5, F.lit(",1"))
    df = t(spark, sf, "orders").select("o_orderkey", F.posexplode(markup.page_selection(text)).alias("pos", "page"))
    return df.select("o_orderkey", F.col("pos").cast("long").alias("pos"), "page")


@query(
    "svg_pages",
    """
    SELECT conv_id, '<svg xmlns="http://www.w3.org/2000/svg" width="2550" height="3300">' || string_agg('<text x="37.5" y="' || (turn * 2 + 1) || '.25">' ||
           replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</text>', '' ORDER BY turn) || '</svg>' AS svg FROM conversations GROUP BY 1""",
)
def _(spark, sf):
    lines = t(spark, sf, "conversations").select("conv_id", "turn", F.lit(375_000).alias("x"), ((F.col("turn") * 2 + 1) * 10_000 + 2500).alias("y"), F.coalesce("text", F.lit("")).alias("text"))
    return svg.pages(lines, ["conv_id"], ["turn"], 2550, 3300)


@query("paint_order", f"SELECT l_orderkey, {_ITEM}, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linestatus, l_partkey % 5, {_ITEM}) AS seq FROM lineitem")
def _(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy("l_linestatus", F.col("l_partkey") % 5, *ITEM)
    return t(spark, sf, "lineitem").select("l_orderkey", *ITEM, F.row_number().over(w).cast("long").alias("seq"))


@query("report_json", """SELECT source, '{"source":"' || source || '","documents":' || count(*) || ',"longest":' || max(n_chars) || '}' AS report FROM documents GROUP BY 1""")
def _(spark, sf):
    df = t(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.max("n_chars").alias("longest"))
    return df.select("source", F.to_json(F.struct("source", "documents", "longest")).alias("report"))


# --- breadth that Spark gives


@query("cube_orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def _(spark, sf):
    total = F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))
    return t(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), total.alias("total"))


@query("pivot_flags", "SELECT l_linestatus, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1")
def _(spark, sf):
    df = t(spark, sf, "lineitem").groupBy("l_linestatus").pivot("l_returnflag", ["A", "N", "R"]).count()
    return df.select("l_linestatus", *(F.coalesce(F.col(c), F.lit(0)).alias(c.lower()) for c in "ANR"))


@query("tumbling_counts", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf):
    df = t(spark, sf, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return df.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


# --- sequential rules


_LEVEL = "CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 1 ELSE 2 END"


@query(
    "list_labels",
    f"""
    WITH i AS (SELECT user_id, list({_LEVEL} ORDER BY event_id) AS x, list(event_id ORDER BY event_id) AS e FROM events GROUP BY 1),
    f AS (SELECT user_id, e, unnest(range(1, len(x) + 1)) AS k, x FROM i),
    r AS (SELECT user_id, e[k] AS event_id, x[k] AS level, list_reduce(list_prepend({{a: 0, b: 0, c: 0}}, list_transform(x[1:k], lambda v: {{a: v, b: 0, c: 0}})), lambda h, v:
        CASE v.a WHEN 0 THEN {{a: h.a + 1, b: 0, c: 0}} WHEN 1 THEN {{a: greatest(h.a, 1), b: h.b + 1, c: 0}} ELSE {{a: greatest(h.a, 1), b: greatest(h.b, 1), c: h.c + 1}} END) AS h FROM f)
    SELECT user_id, event_id, level, h.a || CASE WHEN level > 0 THEN '.' || h.b ELSE '' END || CASE WHEN level > 1 THEN '.' || h.c ELSE '' END AS label FROM r""",
)
def _(spark, sf):
    df = t(spark, sf, "events").select("user_id", "event_id", F.expr(_LEVEL).alias("level"))
    return layout.list_labels(df, ["user_id"], ["event_id"], "level", levels=3)


@query(
    "section_page_numbers",
    """
    WITH s AS (SELECT o_custkey, o_orderkey, o_custkey % 4 + 1 AS pages, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 9 + 1 END AS stated, CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE -1 END AS parity FROM orders),
    i AS (SELECT o_custkey, list({k: o_orderkey, p: pages, s: stated, q: parity, f: 0::BIGINT} ORDER BY o_orderkey) AS x FROM s GROUP BY 1),
    u AS (SELECT o_custkey, x, unnest(range(1, len(x) + 1)) AS n FROM i),
    r AS (SELECT o_custkey, x[n].k AS o_orderkey, list_reduce(list_prepend({k: 0::BIGINT, p: 1::BIGINT, s: NULL::BIGINT, q: -1::INT, f: 0::BIGINT}, list_transform(x[1:n], lambda v: {k: v.k, p: v.p::BIGINT, s: v.s::BIGINT, q: v.q::INT, f: 0::BIGINT})), lambda a, v:
        {k: v.k, p: v.p, s: NULL::BIGINT, q: CASE WHEN v.q >= 0 AND coalesce(v.s, a.f + a.p) % 2 <> v.q THEN 1 ELSE 0 END,
         f: coalesce(v.s, a.f + a.p) + CASE WHEN v.q >= 0 AND coalesce(v.s, a.f + a.p) % 2 <> v.q THEN 1 ELSE 0 END}) AS h FROM u)
    SELECT o_custkey, o_orderkey, h.f AS first_number, h.q = 1 AS blank FROM r""",
)
def _(spark, sf):
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    parity = F.when(o % 3 == 0, "odd").when(o % 3 == 1, "even")
    df = t(spark, sf, "orders").select("o_custkey", "o_orderkey", (c % 4 + 1).alias("pages"), F.when(o % 5 == 0, o % 9 + 1).alias("stated"), parity.alias("parity"))
    return layout.page_numbers(df, ["o_custkey"], "o_orderkey", "pages", "stated", "parity")


@query(
    "word_positions",
    f"""
    WITH w AS (SELECT *, l_partkey % 60 AS w, CASE l_orderkey % 4 WHEN 0 THEN 'left' WHEN 1 THEN 'center' WHEN 2 THEN 'right' ELSE 'justify' END AS al FROM lineitem),
    n AS (SELECT *, row_number() OVER o - 1 AS i, count(*) OVER k AS n, greatest(600 - sum(w) OVER k - 10 * (count(*) OVER k - 1), 0) AS slack, sum(w) OVER o - w AS before FROM w WINDOW k AS (PARTITION BY l_orderkey), o AS (PARTITION BY l_orderkey ORDER BY {_ITEM} ROWS UNBOUNDED PRECEDING))
    SELECT l_orderkey, {_ITEM}, (before + 10 * i + CASE al WHEN 'center' THEN slack // 2 WHEN 'right' THEN slack WHEN 'justify' THEN CASE WHEN n > 1 THEN (slack * i) // (n - 1) ELSE 0 END ELSE 0 END)::BIGINT AS x FROM n""",
)
def _(spark, sf):
    df = t(spark, sf, "lineitem").select("l_orderkey", *ITEM, (F.col("l_partkey") % 60).alias("w"))
    k = F.col("l_orderkey") % 4
    align = F.when(k == 0, "left").when(k == 1, "center").when(k == 2, "right").otherwise("justify")
    out = layout.word_positions(df, ["l_orderkey"], ITEM, "w", 10, 600, align)
    return out.select("l_orderkey", *ITEM, F.col("x").cast("long").alias("x"))


@query(
    "kerned_width",
    """
    WITH c AS (SELECT p_partkey, p_name, unnest(range(1, length(p_name) + 1)) AS i FROM part),
    p AS (SELECT p_partkey, p_name[i] AS r, CASE WHEN i > 1 THEN p_name[i - 1] END AS l FROM c)
    SELECT p_partkey, sum(CASE WHEN r BETWEEN 'a' AND 'z' THEN 400 + 10 * (ascii(r) - 97) ELSE 500 END + CASE WHEN l || r IN ('re', 'to', 'lo') THEN -30 ELSE 0 END)::BIGINT AS width FROM p GROUP BY 1""",
)
def _(spark, sf):
    advances = spark.range(26).select(F.char(F.col("id") + 97).alias("ch"), (400 + 10 * F.col("id")).alias("adv"))
    kerns = spark.createDataFrame([("r", "e", -30), ("t", "o", -30), ("l", "o", -30)], "l string, r string, adj int")
    return layout.kerned_width(t(spark, sf, "part"), "p_partkey", "p_name", advances, kerns)


@query(
    "scaled_widths",
    """
    WITH b AS (SELECT p_brand, p_partkey, greatest(p_size - 4, 0) AS body FROM part),
    s AS (SELECT *, sum(body) OVER (PARTITION BY p_brand) AS a, sum(body) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS u, greatest(3000 - 4 * count(*) OVER (PARTITION BY p_brand), 0) AS pool FROM b)
    SELECT p_partkey, (4 + CASE WHEN a > 0 THEN (pool * u) // a - (pool * (u - body)) // a ELSE 0 END)::BIGINT AS scaled FROM s""",
)
def _(spark, sf):
    df = layout.scaled_widths(t(spark, sf, "part").select("p_brand", "p_partkey", "p_size"), ["p_brand"], ["p_partkey"], "p_size", 4, 3000)
    return df.select("p_partkey", F.col("scaled").cast("long").alias("scaled"))


@query(
    "table_rows_on_pages",
    """
    WITH i AS (SELECT conv_id, list({o: turn, h: length(coalesce(text, '')) % 40 + 5, f: turn = 0, g: 1::BIGINT, u: 0::BIGINT} ORDER BY turn) AS x FROM conversations GROUP BY 1),
    n AS (SELECT conv_id, x, CASE WHEN x[1].f THEN x[1].h ELSE 0 END AS heads, unnest(range(1, len(x) + 1)) AS n FROM i),
    r AS (SELECT conv_id, x[n].o AS turn, list_reduce(list_prepend({h: 0::BIGINT, g: 1::BIGINT, u: -1::BIGINT}, list_transform(x[1:n], lambda v: {h: v.h::BIGINT, g: 0::BIGINT, u: 0::BIGINT})), lambda a, v:
        CASE WHEN a.u >= 0 AND a.u + v.h > 100 THEN {h: v.h, g: a.g + 1, u: heads::BIGINT + v.h} ELSE {h: v.h, g: a.g, u: greatest(a.u, 0) + v.h} END) AS s FROM n)
    SELECT conv_id, turn, s.g AS page FROM r""",
)
def _(spark, sf):
    df = t(spark, sf, "conversations").select("conv_id", "turn", (F.length(F.coalesce("text", F.lit(""))) % 40 + 5).alias("h"), (F.col("turn") == 0).alias("head"))
    return layout.packed_rows(df, "conv_id", "turn", "h", "head", 100)


@query(
    "anchored_positions",
    """
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 100 WHEN 1 THEN 1000 - p_size WHEN 2 THEN 100 + (900 - p_size) // 2 ELSE 100 + p_partkey % 77 END::BIGINT AS x,
           (50 + floor((p_partkey - 3) * 200 / 70.0))::BIGINT AS grouped, CASE p_partkey % 3 WHEN 0 THEN p_size WHEN 1 THEN greatest(p_size, 25) ELSE floor((25 * p_size + 120) / 240.0) END::BIGINT AS pitch FROM part""",
)
def _(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size").cast("long")
    align = F.when(k % 4 == 0, "left").when(k % 4 == 1, "right").when(k % 4 == 2, "center")
    rule = F.when(k % 3 == 0, "exact").when(k % 3 == 1, "atLeast").otherwise("auto")
    x = layout.anchored(align, k % 77, size, F.lit(100), F.lit(1000)).cast("long")
    grouped = layout.in_group(k, F.lit(50), F.lit(3), F.lit(200), F.lit(70)).cast("long")
    return t(spark, sf, "part").select("p_partkey", x.alias("x"), grouped.alias("grouped"), layout.line_pitch(rule, size, F.lit(25)).cast("long").alias("pitch"))


@query(
    "changed_results",
    """
    SELECT doc_id FROM documents WHERE doc_id % 13 = 0 OR doc_id % 11 = 5""",
)
def _(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.concat(F.lit('<p id="a'), "doc_id", F.lit('">'), F.coalesce("text", F.lit("")), F.lit("</p>")).alias("svg"))
    new = d.withColumn("svg", F.when(F.col("doc_id") % 11 == 5, F.concat("svg", F.lit("!"))).otherwise(F.regexp_replace("svg", 'id="a', 'id="b')))
    return layout.changed_results(d.where("doc_id % 13 <> 0"), new, "doc_id", "svg")


#: A few rules of the kind that pattern files hold; any table of patterns can stand here.
_PATTERNS = ("1ti", "n1d", ".an2d", "e2r1", "3st", "t2h", "1h4e")
_HYPHENS = """
    WITH w AS (SELECT DISTINCT unnest(list_filter(string_split_regex(coalesce(text, ''), '[^A-Za-z]+'), lambda x: x <> '')) AS word FROM documents),
    r(l, d) AS (VALUES ('ti', [1, 0, 0]), ('nd', [0, 1, 0]), ('.and', [0, 0, 0, 2, 0]), ('er', [0, 2, 1]), ('st', [3, 0, 0]), ('th', [0, 2, 0]), ('he', [1, 4, 0])),
    g AS (SELECT word, o + k - 2 AS gap, max(d[k + 1]) AS digit FROM (SELECT word, l, d, unnest(range(1, length(word) + 3)) AS o FROM w, r), range(7) AS q(k)
          WHERE ('.' || lower(word) || '.')[o:o + length(l) - 1] = l AND k <= length(l) GROUP BY 1, 2)
    SELECT w.word, coalesce(string_agg(gap::VARCHAR, ',' ORDER BY gap) FILTER (digit % 2 = 1 AND gap >= 2 AND gap <= length(w.word) - 2), '') AS points FROM w LEFT JOIN g USING (word) GROUP BY 1"""


@query("hyphen_points", _HYPHENS)
def hyphen_points(spark, sf):
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[^A-Za-z]+"), lambda w: w != "")
    rules = spark.createDataFrame([(p,) for p in _PATTERNS], "pattern string")
    return layout.hyphen_points(t(spark, sf, "documents").select(F.explode(words).alias("word")), "word", rules)


@query("soft_hyphens", f"SELECT word, CASE WHEN points = '' THEN word ELSE (SELECT string_agg(word[b[i] + 1:b[i + 1]], chr(173) ORDER BY i) FROM (SELECT unnest(range(1, len(b))) AS i)) END AS shown FROM (SELECT word, points, list_prepend(0, list_append(list_transform(list_filter(string_split(points, ','), lambda p: p <> ''), lambda p: p::BIGINT), length(word))) AS b FROM ({_HYPHENS}))")
def _(spark, sf):
    return hyphen_points(spark, sf).select("word", layout.soft_hyphens(F.col("word"), F.col("points")).alias("shown"))


@query(
    "fill_free_segments",
    """
    WITH RECURSIVE w AS (SELECT conv_id, turn, length(coalesce(text, '')) % 60 + 1 AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
    g AS (SELECT conv_id, list(20 + turn % 3 * 30 ORDER BY turn * 100) FILTER (20 + turn % 3 * 30 >= 30) AS g FROM conversations GROUP BY 1),
    s(conv_id, n, turn, seg, pen) AS (
        SELECT DISTINCT conv_id, 0::BIGINT, NULL::BIGINT, 0::BIGINT, 0::BIGINT FROM w
        UNION ALL SELECT s.conv_id, w.n, w.turn, z.seg, CASE WHEN z.seg = s.seg AND s.pen > 0 THEN s.pen + 5 + w.w ELSE w.w END
        FROM s JOIN w ON w.conv_id = s.conv_id AND w.n = s.n + 1 JOIN g ON g.conv_id = s.conv_id,
        LATERAL (SELECT CASE WHEN s.seg >= coalesce(len(g.g), 0) THEN s.seg WHEN CASE WHEN s.pen > 0 THEN s.pen + 5 ELSE 0 END + w.w <= g.g[s.seg + 1] THEN s.seg
                 ELSE coalesce(list_min(list_filter(range(s.seg + 1, coalesce(len(g.g), 0)), lambda k: g.g[k + 1] >= w.w)), coalesce(len(g.g), 0)) END AS seg) z)
    SELECT s.conv_id, turn, CASE WHEN seg < coalesce(len(g.g), 0) THEN seg END AS segment FROM s JOIN g USING (conv_id) WHERE n > 0""",
)
def _(spark, sf):
    c = t(spark, sf, "conversations")
    words = c.select("conv_id", "turn", (F.length(F.coalesce("text", F.lit(""))) % 60 + 1).alias("w"))
    spans = c.select("conv_id", (F.col("turn") * 100).alias("free_from"), (F.col("turn") * 100 + 20 + F.col("turn") % 3 * 30).alias("free_to"))
    return layout.fill_segments(words, spans, "conv_id", "turn", "w", 5, 30)
