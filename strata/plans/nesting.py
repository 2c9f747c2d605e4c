"""Queries over trees: tables in tables on pages, and groups of shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.operators import layout, trees
from strata.operators.rounds import Shelf, parts_of, stacked
from strata.plans.registry import query, t

_ROOM = 60
#: A customer's table holds its orders, an order's its line items, a large item's two rows of its own.
_SQL = f"""
    WITH RECURSIVE l AS (SELECT l_orderkey AS ok, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS n, l_partkey, l_suppkey, l_quantity::BIGINT AS q FROM lineitem),
    o AS (SELECT o_custkey AS ck, o_orderkey AS ok, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n, count(*) OVER (PARTITION BY o_custkey) AS m FROM orders),
    h2 AS (SELECT ok, n, unnest([0, 1]) AS row, unnest([1 + l_partkey % 3, 1 + l_suppkey % 2]) AS height, 2 + l_partkey % 3 + l_suppkey % 2 AS total FROM l WHERE q > 40),
    h1 AS (SELECT l.ok, l.n, greatest(1 + q % 4, coalesce(max(h2.total), 0)) AS height FROM l LEFT JOIN h2 ON h2.ok = l.ok AND h2.n = l.n GROUP BY l.ok, l.n, q),
    b AS (SELECT ck, o.ok, n, m, greatest(1 + coalesce((SELECT sum(height) FROM h1 WHERE h1.ok = o.ok), 0), CASE WHEN n % 4 > 1 OR (n % 4 = 0 AND n + 1 = m) THEN 1 + o.ok % 3 ELSE 0 END) AS base FROM o),
    h0 AS (SELECT *, base + CASE WHEN n % 4 = 1 THEN greatest(0, 3 + lag(ok) OVER w % 20 - base - lag(base) OVER w) ELSE 0 END AS height FROM b WINDOW w AS (PARTITION BY ck ORDER BY n)),
    y0 AS (SELECT *, sum(height) OVER (PARTITION BY ck ORDER BY n) - height AS y FROM h0),
    p(ck, n, page, used) AS (
        SELECT DISTINCT ck, -1::BIGINT, 1::BIGINT, -1::BIGINT FROM y0
        UNION ALL SELECT p.ck, y0.n, CASE WHEN used >= 0 AND used + height > {_ROOM} THEN page + 1 ELSE page END, CASE WHEN used >= 0 AND used + height > {_ROOM} THEN 0 ELSE greatest(used, 0) END + height
        FROM p JOIN y0 ON y0.ck = p.ck AND y0.n = p.n + 1),
    y1 AS (SELECT h1.ok, h1.n, h1.height, y0.ck, y0.n AS on_row, y0.y + 1 + (sum(h1.height) OVER (PARTITION BY h1.ok ORDER BY h1.n)) - h1.height AS y FROM h1 JOIN y0 ON y0.ok = h1.ok)"""


def _tree(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame, Shelf]:
    """Tables, cells (dealt by table to as many parts as the shelf has), the spanning ones of them, and the shelf with what they are read from."""
    items = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    shelf = Shelf(spark, parts_of(items, 250_000))
    long = lambda **c: [v.cast("long").alias(k) for k, v in c.items()]
    q, n, by = F.col("l_quantity").cast("long"), F.col("n"), Window.partitionBy("table")
    of = lambda df, kind, key: df.where(F.col(key).isNotNull()).withColumn("table", F.concat(F.lit(f"{kind}:"), key)).repartition(shelf.parts, "table")
    lines = of(items, "o", "l_orderkey").withColumn("n", F.row_number().over(by.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")) - 1)
    lines = shelf.put("lines", lines.select("table", *long(n=n, content=1 + q % 4, first=1 + F.col("l_partkey") % 3, second=1 + F.col("l_suppkey") % 2), (q > 40).alias("large")), "table")
    orders = of(t(spark, sf, "orders").select("o_custkey", "o_orderkey"), "c", "o_custkey")
    orders = orders.select("table", F.col("o_orderkey").alias("ok"), *long(n=F.row_number().over(by.orderBy("o_orderkey")) - 1, m=F.count(F.lit(1)).over(by)))
    orders = shelf.put("orders", orders, "table")
    item = F.concat(F.lit("l"), F.expr("substring(table, 2)"), F.lit(":"), n)
    one, none = F.lit(1).cast("long"), F.lit(None).cast("long")
    inner = lines.where("large").withColumn("item", item)
    tables = orders.select("table", F.lit(None).cast("string").alias("up"), none.alias("up_row"), none.alias("up_column")).distinct()
    held = lambda df, name: df.select(name.alias("table"), F.col("table").alias("up"), n.alias("up_row"), one.alias("up_column"))
    tables = tables.unionByName(held(orders.where("ok IS NOT NULL"), F.concat(F.lit("o:"), "ok"))).unionByName(held(inner, F.col("item")))
    cell = lambda row, column, content: F.struct(row.cast("long").alias("row"), F.lit(column).alias("column"), content.cast("long").alias("content"))
    every = lambda df, rows, *found: df.select("table", F.inline(F.array(*found))).withColumn("rows", F.lit(rows).cast("long"))
    span = (n % 4 == 0) & (n + 1 < F.col("m"))
    spanning = every(orders.where(span), 2, cell(n, 0, 3 + F.col("ok") % 20))
    single = every(orders.where(~span & (n % 4 != 1)), 1, cell(n, 0, 1 + F.col("ok") % 3))
    large = inner.select(F.col("item").alias("table"), "first", "second").repartition(shelf.parts, "table")
    own = every(lines, 1, cell(n, 0, F.col("content")), cell(n, 1, F.lit(0)))
    cells = stacked("table", spanning, single, every(orders, 1, cell(n, 1, one)), own, every(large, 1, cell(F.lit(0), 0, F.col("first")), cell(F.lit(1), 0, F.col("second"))))
    return tables, cells, spanning, shelf


def _pages(rows: DataFrame) -> DataFrame:
    """(table, row, mark): the page of each of the outermost rows."""
    rows = rows.select(F.substring_index("table", ":", -1).cast("long").alias("k"), "row", "height", F.lit(False).alias("head"))
    pages = layout.packed_rows(rows, "k", "row", "height", "head", _ROOM)
    return pages.select(F.concat(F.lit("c:"), F.col("k")).alias("table"), "row", F.col("page").alias("mark"))


@query(
    "nested_tables",
    f"""{_SQL}
    SELECT 'c:' || y0.ck AS "table", 0 AS depth, y0.n AS "row", height, y, page FROM y0 JOIN p ON p.ck = y0.ck AND p.n = y0.n
    UNION ALL SELECT 'o:' || ok, 1, y1.n, height, y, page FROM y1 JOIN p ON p.ck = y1.ck AND p.n = on_row
    UNION ALL SELECT 'l:' || h2.ok || ':' || h2.n, 2, h2.row, h2.height, y1.y + CASE WHEN h2.row = 1 THEN h2.total - h2.height ELSE 0 END, page
    FROM h2 JOIN y1 ON y1.ok = h2.ok AND y1.n = h2.n JOIN p ON p.ck = y1.ck AND p.n = on_row""",
)
def _(spark, sf):
    """Rows of tables in tables, three deep: heights from the innermost out, places from the outermost in, and the page of each."""
    tables, cells, _, shelf = _tree(spark, sf)
    found = trees.nested_tables(tables, cells, _pages, shelf.parts)
    shelf.drop()
    return found.select("table", F.col("depth").cast("int").alias("depth"), "row", "height", "y", F.col("mark").alias("page"))


@query(
    "spanning_cells_on_pages",
    f"""{_SQL}
    SELECT 'c:' || a.ck AS "table", a.n AS "row", p.page, sum(b.height)::BIGINT AS height, p.page > min(p.page) OVER (PARTITION BY a.ck, a.n) AS carried
    FROM y0 a JOIN y0 b ON b.ck = a.ck AND b.n IN (a.n, a.n + 1) JOIN p ON p.ck = b.ck AND p.n = b.n WHERE a.n % 4 = 0 AND a.n + 1 < a.m GROUP BY a.ck, a.n, p.page""",
)
def _(spark, sf):
    """What each page shows of the cells that span two rows of a customer's table."""
    tables, cells, spanning, shelf = _tree(spark, sf)
    found = trees.outermost_rows(tables, cells, shelf.parts)
    shelf.drop("lines")
    rows = found.join(_pages(found), ["table", "row"]).withColumnRenamed("mark", "page")
    return trees.spanning_pieces(spanning, rows).select("table", "row", "page", "height", "carried")


@query(
    "grouped_shapes",
    """
    WITH RECURSIVE s AS (SELECT p_partkey AS id, CASE WHEN p_partkey >= 6 THEN p_partkey // 6 END AS up, p_size AS z, p_partkey % 40 AS ox, p_size % 30 AS oy, 20 * (1 + p_partkey % 2) AS w, 40 AS h, p_partkey % 4 AS q, p_size % 3 = 0 AS fh, p_size % 5 = 0 AS fv FROM part),
    f AS (SELECT *, CASE WHEN fh THEN -1 ELSE 1 END * w / 40.0 AS kx, CASE WHEN fv THEN -1 ELSE 1 END * h / 20.0 AS ky, ox + w / 2.0 AS mx, oy + h / 2.0 AS my, [1, 0, -1, 0][q + 1] AS c, [0, 1, 0, -1][q + 1] AS n FROM s),
    r(id, inn, x, y) AS (
        SELECT id, id, 10.0::DOUBLE, 5.0::DOUBLE FROM f
        UNION ALL SELECT r.id, f.up, (c * (CASE WHEN fh THEN -1 ELSE 1 END * (ox - mx) + kx * (x - 4)) - n * (CASE WHEN fv THEN -1 ELSE 1 END * (oy - my) + ky * (y - 2)) + mx)::DOUBLE,
                         (n * (CASE WHEN fh THEN -1 ELSE 1 END * (ox - mx) + kx * (x - 4)) + c * (CASE WHEN fv THEN -1 ELSE 1 END * (oy - my) + ky * (y - 2)) + my)::DOUBLE
        FROM r JOIN f ON f.id = r.inn)
    SELECT id, x, y FROM r WHERE inn IS NULL""",
)
def _(spark, sf):
    """A point of every shape on the page, through all the groups it is in: scaled, mirrored and turned by quarters."""
    k, size = F.col("p_partkey"), F.col("p_size")
    lit = lambda *v: tuple(F.lit(x) for x in v)
    own = trees.group_map((k % 40, size % 30), (20 * (1 + k % 2), F.lit(40)), lit(4, 2), lit(40, 20), (k % 4) * 5_400_000, size % 3 == 0, size % 5 == 0)
    nodes = t(spark, sf, "part").select(k.alias("id"), F.expr("CASE WHEN p_partkey >= 6 THEN p_partkey div 6 END").alias("up"), own.alias("map"))
    x, y = trees.mapped("map", F.lit(10), F.lit(5))
    return trees.composed(nodes).select("id", x.alias("x"), y.alias("y"))
