"""Queries over packages: conversations written as packages, scanned and resolved."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators.rounds import cut
from strata.plans.registry import query, t
from strata.sources.package import lists, paragraphs, scan_contents
from strata.sources.writer import packages

_TEXT = r"regexp_replace(coalesce(text, ''), '[\x00-\x08\x0B-\x1F]', '', 'g')"
_ONE = "(SELECT DISTINCT conv_id AS k, conv_id || '.docx' AS path FROM conversations)"
_MAIN = "word/document.xml"


def contents(spark, sf):
    return packages(t(spark, sf, "conversations"), "conv_id", "turn", "role", "text")


def scanned(spark, sf, *kinds):
    """Rows of some kinds, staged: queries take them apart and join the parts, and each part would scan all packages again."""
    return cut(scan_contents(contents(spark, sf), kinds))


def value_of(kind, name, column="value"):
    return F.max(F.when((F.col("kind") == kind) & (F.col("name") == name), F.col(column)))


@query(
    "package_blocks",
    f"""
    SELECT conv_id || '.docx' AS path, count(*) AS paragraphs, count(*) FILTER (turn % 3 = 2) AS tables, count(*) FILTER (turn % 3 = 2) AS cells,
           string_agg(coalesce(role, '') || ':' || {_TEXT} || CASE turn % 4 WHEN 1 THEN turn::VARCHAR WHEN 2 THEN 'new' ELSE '' END, '|' ORDER BY turn) AS text
    FROM conversations GROUP BY conv_id""",
)
def _(spark, sf):
    rows = scanned(spark, sf, "paragraph", "run", "table", "cell").where(F.col("part") == _MAIN)
    count = lambda kind: F.count(F.when(F.col("kind") == kind, 1)).alias(f"{kind}s")
    lines = F.array_sort(F.collect_list(F.struct("ord", F.concat("style", F.lit(":"), "text").alias("line"))))
    text = paragraphs(rows).groupBy("path").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "|").alias("text"))
    return rows.groupBy("path").agg(count("paragraph"), count("table"), count("cell")).join(text, "path")


@query("package_parts", f"SELECT path, 13 AS parts, 9 AS typed, 9 AS links FROM {_ONE}")
def _(spark, sf):
    rows = scanned(spark, sf, "part", "relationship")
    part = F.col("kind") == "part"
    return rows.groupBy("path").agg(F.count(F.when(part, 1)).alias("parts"), F.count(F.when(part & (F.length("value") > 0), 1)).alias("typed"), F.count(F.when(~part, 1)).alias("links"))


@query(
    "package_styles",
    f"""
    SELECT path, 'Normal' AS style, '' AS based_on, (20 + k % 5)::VARCHAR AS size, NULL AS bold FROM {_ONE}
    UNION ALL SELECT path, 'user', 'Normal', NULL, 'true' FROM {_ONE}""",
)
def _(spark, sf):
    rows = scanned(spark, sf, "style").where("digest = 'paragraph'")
    return rows.select("path", F.col("name").alias("style"), F.col("parent").alias("based_on"), F.get_json_object("value", "$['sz.val']").alias("size"), F.get_json_object("value", "$.b").alias("bold"))


@query("package_settings", f"SELECT path, 700 + k % 10 AS tab_stop, k % 2 = 1 AS even_and_odd, 14 + k % 2 AS mode FROM {_ONE}")
def _(spark, sf):
    rows = scanned(spark, sf, "setting").groupBy("path")
    even = F.coalesce(value_of("setting", "evenAndOddHeaders").isin("true", "1", "on"), F.lit(False))
    return rows.agg(value_of("setting", "defaultTabStop").cast("long").alias("tab_stop"), even.alias("even_and_odd"), value_of("setting", "compatibilityMode").cast("long").alias("mode"))


@query("package_theme", f"SELECT path, 'Head ' || k % 7 AS head, 'Body ' || k % 3 AS body, 'Mincho' AS japanese, '000000' AS dk1, upper(printf('%02x', (k % 256)::INT)) || 'AA00' AS accent1 FROM {_ONE}")
def _(spark, sf):
    rows = scanned(spark, sf, "theme_font", "theme_color").withColumn("name", F.concat_ws(".", F.nullif("parent", F.lit("")), "name"))
    names = {"head": ("theme_font", "majorFont.latin"), "body": ("theme_font", "minorFont.latin"), "japanese": ("theme_font", "majorFont.Jpan"), "dk1": ("theme_color", "dk1"), "accent1": ("theme_color", "accent1")}
    return rows.groupBy("path").agg(*(value_of(*n).alias(c) for c, n in names.items()))


@query(
    "package_lists",
    f"""
    SELECT path, i.list, i.instance, l AS level, CASE WHEN i.instance = '2' AND l = 1 THEN 5 + k % 4 ELSE l + 1 END AS start, '%' || (l + 1) || '.' AS text, i.instance = '2' AND l = 1 AS restarted
    FROM {_ONE}, (VALUES ('0', '1'), ('0', '2'), ('2', '3')) AS i(list, instance), range(3) AS r(l)""",
)
def _(spark, sf):
    found = lists(scanned(spark, sf, "list_definition", "list_level", "list_instance", "list_override", "style"))
    return found.select("path", "list", "instance", F.col("level").cast("long").alias("level"), F.col("start").cast("long").alias("start"), "text", F.col("override").isNotNull().alias("restarted"))


@query("package_fonts", f"SELECT path, 'Head ' || k % 7 AS font, 'roman' AS family, 'variable' AS pitch FROM {_ONE} UNION ALL SELECT path, 'Mono', 'modern', 'fixed' FROM {_ONE}")
def _(spark, sf):
    return scanned(spark, sf, "font").select("path", F.col("name").alias("font"), F.col("value").alias("family"), F.col("parent").alias("pitch"))


@query(
    "package_notes",
    f"""
    SELECT conv_id || '.docx' AS path, turn::VARCHAR AS note, 'normal' AS type, 'note ' || turn AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE turn % 4 = 3
    UNION ALL SELECT path, '-1', 'separator', '', NULL FROM {_ONE}""",
)
def _(spark, sf):
    rows = scanned(spark, sf, "footnote", "note_reference", "paragraph")
    order = rows.where("kind = 'paragraph'").select("path", F.col("parent").alias("at"), F.col("ord").alias("block"))
    uses = rows.where("kind = 'note_reference'").select("path", F.col("parent").alias("at"), "ord", F.col("value").alias("note")).join(order, ["path", "at"])
    places = uses.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("block", "ord", "note"))).alias("notes")).select("path", F.posexplode("notes").alias("place", "n")).select("path", (F.col("place") + 1).cast("long").alias("place"), F.col("n.note").alias("note"))
    notes = rows.where("kind = 'footnote'").select("path", F.col("name").alias("note"), F.col("parent").alias("type"), F.col("value").alias("text"))
    return notes.join(places, ["path", "note"], "left")


@query("package_stories", f"SELECT path, 'header' AS story, 'default' AS page_type, 'Conversation ' || k AS text FROM {_ONE}")
def _(spark, sf):
    rows = scanned(spark, sf, "story_reference", "relationship", "paragraph", "run")
    used = rows.where("kind = 'story_reference'").select("path", F.col("parent").alias("story"), F.col("name").alias("page_type"), F.col("value").alias("id"))
    linked = rows.where("kind = 'relationship'").select("path", F.col("name").alias("id"), F.concat(F.lit("word/"), "value").alias("part"))
    parts = rows.where("kind IN ('paragraph', 'run')").select("path", "part", "parent").distinct()
    text = paragraphs(rows).join(parts, ["path", "parent"]).select("path", "part", "text")
    return used.join(linked, ["path", "id"]).join(text, ["path", "part"]).select("path", "story", "page_type", "text")


@query(
    "package_pictures",
    f"""
    SELECT conv_id || '.docx' AS path, count(*) FILTER (turn % 4 = 3) AS uses, 'image/png' AS type, sha256('picture ' || conv_id % 10) AS digest, true AS is_bullet FROM conversations GROUP BY conv_id""",
)
def _(spark, sf):
    rows = scanned(spark, sf, "picture", "drawing", "bullet")
    uses = rows.where("kind = 'drawing'").groupBy("path", F.get_json_object("value", "$.picture").alias("name")).agg(F.count(F.lit(1)).alias("uses"))
    bullets = rows.where("kind = 'bullet'").select("path", F.col("value").alias("name"), F.lit(True).alias("bullet"))
    found = rows.where("kind = 'picture'").select("path", "name", F.col("value").alias("type"), "digest").join(uses, ["path", "name"], "left").join(bullets, ["path", "name"], "left")
    return found.select("path", F.coalesce("uses", F.lit(0)).alias("uses"), "type", "digest", F.coalesce("bullet", F.lit(False)).alias("is_bullet"))


@query("package_fields", "SELECT conv_id || '.docx' AS path, 'PAGEREF t' || (turn - 1) AS instruction, turn::VARCHAR AS cached, 0 AS depth FROM conversations WHERE turn % 4 = 1")
def _(spark, sf):
    return scanned(spark, sf, "field").select("path", F.col("name").alias("instruction"), F.col("value").alias("cached"), F.col("level").alias("depth"))


@query("package_page_count", f"SELECT path, nullif(k % 3, 0) AS pages FROM {_ONE}")
def _(spark, sf):
    return scanned(spark, sf, "part", "pages").groupBy("path").agg(F.max(F.when(F.col("kind") == "pages", F.col("value").cast("long"))).alias("pages"))


@query("package_drawings", "SELECT conv_id || '.docx' AS path, turn * 12700 // 635 AS width, 15 AS height, turn AS x, 'page' AS relative_to, 'wrapSquare' AS wrap FROM conversations WHERE turn % 4 = 3")
def _(spark, sf):
    told = lambda c: F.get_json_object("value", f"$['{c}']")
    twips = lambda c: F.floor(told(c).cast("long") / 635)
    return scanned(spark, sf, "drawing").select("path", twips("cx").alias("width"), twips("cy").alias("height"), twips("positionH.posOffset").alias("x"), told("positionH").alias("relative_to"), told("wrap").alias("wrap"))


@query("package_bookmarks", "SELECT conv_id || '.docx' AS path, 't' || turn AS name, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations")
def _(spark, sf):
    rows = scanned(spark, sf, "paragraph", "bookmarkStart", "bookmarkEnd").where(F.col("part") == _MAIN)
    ends = rows.where("kind = 'bookmarkEnd'").select("path", "name", F.lit(True).alias("ended"))
    marks = rows.where("kind = 'bookmarkStart'").select("path", "name", F.col("value").alias("mark"), "parent").join(ends, ["path", "name"])
    blocks = rows.where("kind = 'paragraph'").select("path", "parent", "ord")
    placed = blocks.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", "parent"))).alias("b")).select("path", F.posexplode("b").alias("place", "x")).select("path", (F.col("place") + 1).cast("long").alias("place"), F.col("x.parent").alias("parent"))
    return marks.join(placed, ["path", "parent"]).select("path", F.col("mark").alias("name"), "place")


@query("package_grids", "SELECT conv_id || '.docx' AS path, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS number, 2000 + turn AS width FROM conversations WHERE turn % 3 = 2")
def _(spark, sf):
    rows = scanned(spark, sf, "table", "grid_column")
    grids = rows.where("kind = 'grid_column'").select("path", "parent", F.col("value").cast("long").alias("width"))
    tables = rows.where("kind = 'table'").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", "parent"))).alias("b")).select("path", F.posexplode("b").alias("n", "x")).select("path", (F.col("n") + 1).cast("long").alias("number"), F.col("x.parent").alias("parent"))
    return tables.join(grids, ["path", "parent"]).select("path", "number", "width")


@query("package_errors", f"SELECT path, CASE WHEN k % 2 = 1 THEN 1 ELSE 0 END AS errors, CASE WHEN k % 2 = 1 THEN 0 ELSE 13 END AS parts FROM {_ONE}")
def _(spark, sf):
    odd = F.regexp_extract("path", "^[0-9]+", 0).cast("long") % 2 == 1
    damaged = contents(spark, sf).withColumn("content", F.when(odd, F.expr("substring(content, 1, 100)")).otherwise(F.col("content")))
    return scan_contents(damaged, ("error", "part")).groupBy("path").agg(F.count(F.when(F.col("kind") == "error", 1)).alias("errors"), F.count(F.when(F.col("kind") == "part", 1)).alias("parts"))


@query(
    "scan_cache_stale",
    """
    SELECT path, CASE WHEN old_size IS NULL THEN 'new' WHEN old_size <> size OR old_time <> time THEN 'changed' ELSE 'same' END AS state
    FROM (SELECT o_orderkey AS path, o_custkey AS size, o_orderdate AS time, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey + (o_orderkey % 7 = 0)::INT END AS old_size, o_orderdate + to_days((o_orderkey % 11 = 0)::INT) AS old_time FROM orders)""",
)
def _(spark, sf):
    o = t(spark, sf, "orders")
    files = o.select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("size"), F.col("o_orderdate").alias("time"))
    held = o.where("o_orderkey % 5 > 0").select(F.col("o_orderkey").alias("path"), (F.col("o_custkey") + (F.col("o_orderkey") % 7 == 0).cast("int")).alias("old_size"), F.expr("o_orderdate + make_dt_interval(CAST(o_orderkey % 11 = 0 AS INT))").alias("old_time"))
    state = F.when(F.col("old_size").isNull(), "new").when((F.col("size") != F.col("old_size")) | (F.col("time") != F.col("old_time")), "changed").otherwise("same")
    return files.join(held, "path", "left").select("path", state.alias("state"))
