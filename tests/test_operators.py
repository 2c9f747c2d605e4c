"""Operators beyond SQL: folds against plain loops, packages, streams and awkward rows."""

import random
import zipfile

import pytest
from pyspark.sql import functions as F

from strata.__main__ import main
from strata.functions import numbers as num
from strata.operators import diff, fold, grid, joins, layout, resolve, sequence
from strata.operators.numbering import list_items
from strata.operators.rounds import dealt
from strata.plans import catalogue, document  # noqa: F401
from strata.plans.packages import contents, scanned
from strata.plans.registry import QUERIES
from strata.sources.package import paragraphs, read_package, scan_contents, scan_packages
from strata.sources.patterns import read_exceptions, read_patterns
from strata.streaming.incremental import current, event_windows, keep_current, recompute


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_roman_round_trip(spark):
    value = {"m": 1000, "d": 500, "c": 100, "l": 50, "x": 10, "v": 5, "i": 1}
    for n, text in values(spark.range(1, 4000).select("id", num.roman(F.col("id")).alias("r")), "id", "r"):
        digits = [value[c] for c in text]
        assert n == sum(-d if any(e > d for e in digits[k + 1 : k + 2]) else d for k, d in enumerate(digits))
    assert values(spark.range(1).select(num.roman(F.col("id")).alias("a"), num.letters(F.col("id")).alias("b")), "a", "b") == [(" ", " ")]
    assert spark.range(1).select(num.letters(F.lit(53)).alias("x")).first().x == "aaa"


def test_wrap_is_greedy(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("x" * rng.randint(1, 30) for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(60, None), (61, ""), (62, "y" * 500)]
    got = {r.i: tuple(r.w) for r in spark.createDataFrame(rows, "i long, t string").select("i", fold.wrapped(F.col("t"), 40).alias("w")).collect()}
    for i, text in rows:
        lines, pen = 1, 0
        for w in (text or "").split():
            if pen and pen + 1 + len(w) > 40:
                lines, pen = lines + 1, len(w)
            else:
                pen += len(w) + (1 if pen else 0)
        assert got[i] == (lines, pen)


@pytest.mark.parametrize("seed", range(3))
def test_pages_keep_every_line_in_order(spark, seed):
    rng = random.Random(seed)
    rows = [(d, b, rng.randint(1, 25), rng.random() < 0.2, rng.random() < 0.2, rng.random() < 0.05) for d in range(15) for b in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, block long, lines long, keep_lines boolean, keep_next boolean, break_before boolean")
    for d in range(15):
        pieces = [r for r in sorted(fold.paginate(df.where(f"doc_id = {d}"), 20).collect(), key=lambda r: (r.block, r.first_line))]
        assert [p.page for p in pieces] == sorted(p.page for p in pieces)
        fill, done = {}, {}
        for p in pieces:
            assert p.first_line == done.get(p.block, 0)
            done[p.block] = p.first_line + p.lines
            fill[p.page] = fill.get(p.page, 0) + p.lines
        assert done == {b: n for x, b, n, *_ in rows if x == d}
        assert max(fill.values()) <= 20 and sorted(fill) == list(range(1, len(fill) + 1))


def test_overlaps_equal_a_full_product(spark):
    rng = random.Random(2)
    rows = [(i, i % 3, a, a + rng.randint(0, 40)) for i in range(150) for a in [rng.randint(-50, 300)]]
    x = spark.createDataFrame(rows, "i long, k long, a long, b long")
    y = x.select(F.col("i").alias("j"), "k", F.col("a").alias("c"), F.col("b").alias("d"))
    want = sorted((i, j) for i, k, a, b in rows for j, m, c, d in rows if k == m and a < b and c < d and a < d and c < b)
    assert values(joins.overlaps(x, y, ["k"], ("a", "b"), ("c", "d"), 16), "i", "j") == want


def test_chains_end_at_cycles_and_other_kinds(spark):
    nodes = spark.createDataFrame([(1, None, "p"), (2, 1, "p"), (3, 2, "c"), (4, 5, "p"), (5, 4, "p"), (6, 2, "p")], "id long, up long, kind string")
    got = resolve.chains(nodes, "id", "up", "kind").groupBy("id").agg(F.max("depth").alias("d"))
    assert values(got, "id", "d") == [(1, 0), (2, 1), (3, 0), (4, 1), (5, 1), (6, 2)]


def test_chains_have_no_greatest_length(spark):
    nodes = spark.range(60).selectExpr("id", "CASE WHEN id > 0 THEN id - 1 END AS up", "'p' AS kind")
    got = resolve.chains(nodes, "id", "up", "kind").groupBy("id").agg(F.max("depth").alias("d"), F.max_by("ancestor", "depth").alias("root"))
    assert values(got, "id", "d", "root") == [(i, i, 0) for i in range(60)]


def test_toggles(spark):
    for base, a, b, direct, want in ((False, True, True, None, False), (True, True, True, None, True), (True, False, None, None, False), (False, True, False, None, True), (False, True, None, False, False)):
        one = [F.lit(v).cast("boolean") for v in (base, a, b, direct)]
        assert spark.range(1).select(resolve.toggled(one[0], one[1:3], one[3]).alias("t")).first().t is want


def test_free_and_merged_spans_cover_the_line(spark):
    rng = random.Random(3)
    rows = [(0, a, a + rng.randint(1, 9)) for a in (rng.randint(0, 200) for _ in range(40))]
    df = spark.createDataFrame(rows, "k long, a long, b long")
    covered = {x for _, a, b in rows for x in range(a, b)}
    low, high = min(covered), max(covered) + 1
    assert {x for _, a, b in values(grid.free_spans(df, ["k"], "a", "b"), "k", "free_from", "free_to") for x in range(a, b)} == set(range(low, high)) - covered
    assert {x for _, a, b in values(grid.merged_spans(df, ["k"], "a", "b"), "k", "a", "b") for x in range(a, b)} == covered


def test_windows_on_empty_and_null_rows(spark):
    empty = spark.createDataFrame([], "k long, o long, v string, n long")
    assert sequence.islands(empty, ["k"], ["o"], F.col("v")).count() == 0
    assert sequence.merge_with_next(empty, ["k"], "o", F.lit(True), F.col("v")).count() == 0
    nulls = spark.createDataFrame([(None, 1, None, 2), (None, 2, None, None), (None, 3, "a", 1)], "k long, o long, v string, n long")
    assert values(sequence.islands(nulls, ["k"], ["o"], F.col("v")), "o", "island") == [(1, 1), (2, 1), (3, 2)]
    assert values(sequence.as_of(nulls, ["k"], ["o"], F.col("v")), "o", "found") == [(1, "a"), (2, "a"), (3, "a")]


def test_changed_windows_merge_when_they_touch(spark):
    df = spark.createDataFrame([(0, 0), (0, 3), (0, 9), (1, 5)], "k long, i long")
    assert values(diff.changed_windows(df, ["k"], "i"), "k", "first", "last") == [(0, 0, 4), (0, 8, 10), (1, 4, 6)]


def package(path, body, styles=""):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    rel = "http://schemas.openxmlformats.org"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("_rels/.rels", f'<Relationships xmlns="{rel}/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {w}>{styles}</w:styles>")


def test_package_scan(spark, tmp_path):
    run = "<w:r><w:t>{}</w:t></w:r>".format
    body = f'<w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr>{run("Head")}<w:ins>{run("er")}</w:ins><w:del><w:r><w:delText>gone</w:delText></w:r></w:del></w:p>'
    body += f'<w:tbl><w:tr><w:tc><w:p>{run("cell")}</w:p></w:tc></w:tr></w:tbl><w:sdt><w:sdtContent><w:p>{run("a")}<w:r><w:tab/><w:t>b</w:t></w:r></w:p></w:sdtContent></w:sdt><w:sectPr/>'
    package(tmp_path / "a.docx", body, '<w:style w:styleId="H1" w:type="paragraph"/><w:style w:styleId="H1"><w:basedOn w:val="X"/></w:style>')
    (tmp_path / "b.docx").write_bytes(b"not a package")
    rows = scan_packages(spark, str(tmp_path)).cache()
    assert [(r.text, r.style) for r in paragraphs(rows).orderBy("ord").collect()] == [("Header", "H1"), ("cell", ""), ("a\tb", "")]
    kinds = {r["kind"]: r["count"] for r in rows.groupBy("kind").count().collect()}
    assert kinds["error"] == 1 and kinds["table"] == 1 and kinds["style"] == 1 and kinds["section_end"] == 1


def test_damaged_packages_give_error_rows(spark, tmp_path):
    package(tmp_path / "a.docx", "<w:p><w:r><w:t>text</w:t></w:r></w:p>" * 50)
    whole = (tmp_path / "a.docx").read_bytes()
    name = whole.index(b"word/document.xml")
    (tmp_path / "b.docx").write_bytes(whole[: name + 40] + bytes(60) + whole[name + 100 :])
    (tmp_path / "c.docx").write_bytes(whole.replace(b"word/document.xml", b"word/document.xyz"))
    rows = scan_packages(spark, str(tmp_path)).groupBy(F.element_at(F.split("path", "/"), -1).alias("f")).agg(F.count(F.when(F.col("kind") == "error", 1)).alias("e"), F.count(F.when(F.col("kind") == "paragraph", 1)).alias("p"))
    assert values(rows, "f", "e", "p") == [("a.docx", 0, 50), ("b.docx", 1, 0), ("c.docx", 1, 0)]
    assert [r["kind"] for r in read_package("none", b"")] == [r["kind"] for r in read_package("none", None)] == ["error"]


def measured(df):
    return df.withColumn("size", F.length("text").cast("long"))


def test_recompute_equals_full_after_edits(spark):
    rng = random.Random(4)
    rows = {i: "x" * rng.randint(0, 9) for i in range(40)}
    memo = None
    for _ in range(3):
        df = spark.createDataFrame(list(rows.items()), "id long, text string")
        now = recompute(df, memo, "id", ["text"], measured).cache()
        assert values(now, "id", "size") == sorted((i, len(x)) for i, x in rows.items())
        memo = now
        for i in rng.sample(sorted(rows), 5):
            rows[i] = "y" * rng.randint(0, 20)


def test_stream_of_edits_keeps_the_current_table(spark, tmp_path):
    schema = "id long, version long, text string"
    for edits in ([(1, 1, "a"), (2, 1, "bb")], [(1, 2, "ccc"), (3, 1, "a")], [(1, 1, "late")], [(2, 5, "dddd")]):
        spark.createDataFrame(edits, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "edits"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "edits"))
        keep_current(spark, stream, str(tmp_path / "state"), "id", "version", ["text"], measured, str(tmp_path / "checkpoint")).awaitTermination()
    assert values(current(spark, str(tmp_path / "state")), "id", "version", "size") == [(1, 2, 3), (2, 5, 4), (3, 1, 1)]
    # Keys lie in parts; one that no manifest of the last two batches names is gone.
    assert len(list((tmp_path / "state" / "data").rglob("*.parquet"))) <= 5


def test_event_windows_over_a_stream(spark, tmp_path):
    events = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id * 10) AS ts, 'a' AS kind FROM range(12)")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    query = event_windows(stream, "ts", "kind", "1 hour", "1 hour").writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert values(spark.table("hours"), "n") == values(event_windows(events, "ts", "kind", "1 hour", "1 hour"), "n") == [(6,), (6,)]


def test_hyphen_points_equal_a_plain_search(spark):
    rules = ["1ti", "n1d", ".an2d", "e2r1", "3st", "t2h", "1h4e", "4o.", "a1b2c"]
    words = ["thandition", "and", "heresta", "abcabc", "o", "Andere", "stto"]
    got = dict(values(layout.hyphen_points(spark.createDataFrame([(w,) for w in words], "word string"), "word", spark.createDataFrame([(r,) for r in rules], "pattern string")), "word", "points"))
    for word in words:
        dotted, gaps = f".{word.lower()}.", {}
        for rule in rules:
            letters = "".join(c for c in rule if not c.isdigit())
            digits, k = [0] * (len(letters) + 1), 0
            for c in rule:
                if c.isdigit():
                    digits[k] = int(c)
                else:
                    k += 1
            for at in range(len(dotted) - len(letters) + 1):
                if dotted[at : at + len(letters)] == letters:
                    for i, d in enumerate(digits):
                        gaps[at + i - 1] = max(gaps.get(at + i - 1, 0), d)
        want = [g for g, d in sorted(gaps.items()) if d % 2 and 2 <= g <= len(word) - 2]
        assert got[word] == ",".join(map(str, want))
    stated = spark.createDataFrame([("and", "1")], "word string, points string")
    assert dict(values(layout.hyphen_points(spark.createDataFrame([("And",)], "word string"), "word", spark.createDataFrame([("n1d",)], "pattern string"), stated), "word", "points")) == {"And": "1"}


def test_segments_fill_from_left_to_right(spark):
    words = spark.createDataFrame([(1, i, w) for i, w in enumerate([10, 10, 30, 5, 90])] + [(2, 0, 1)], "k long, o long, w int")
    spans = spark.createDataFrame([(1, 0, 25), (1, 30, 35), (1, 50, 90)], "k long, free_from int, free_to int")
    assert values(layout.fill_segments(words, spans, "k", "o", "w", 5, 10), "k", "o", "segment") == [(1, 0, 0), (1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, None), (2, 0, None)]


def test_fixpoint_settles_or_stops(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    start = spark.range(5).selectExpr("id", "id * 10 AS v")
    table, passes, settled = layout.fixpoint(start, lambda d: d.selectExpr("id", "least(v + 20, 50) AS v"))
    assert settled and passes == 4 and {r.v for r in table.collect()} == {50}
    assert layout.fixpoint(start, lambda d: d.selectExpr("id", "v + 1 AS v"))[1:] == (4, False)


def test_pattern_files_and_word_lists(spark, tmp_path):
    import gzip

    (tmp_path / "hyph_en.dic").write_text("UTF-8\nLEFTHYPHENMIN 2\n% comment\n1ti\nn1d % why\n\n1ti\n")
    with gzip.open(tmp_path / "hyph_de.dic.gz", "wt") as f:
        f.write("ISO8859-1\n.an2d\n")
    rules = read_patterns(spark, str(tmp_path / "hyph_*"))
    assert values(rules, "pattern") == [(".an2d",), ("1ti",), ("n1d",)]
    (tmp_path / "words.txt").write_text("ta-ble\nun-der-Stand\nplain\n")
    assert values(read_exceptions(spark, str(tmp_path / "words.txt")), "word", "points") == [("plain", ""), ("table", "2"), ("understand", "2,5")]


def test_command_line(spark, sf_dir, tmp_path, capsys):
    assert main(["list"]) == 0 and "fitted_grids" in capsys.readouterr().out
    assert main(["cube_orders", sf_dir, str(tmp_path / "out"), "--strict"], spark) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0
    assert main(["no such query", sf_dir, str(tmp_path / "out")], spark) == 2


def test_list_items_of_unknown_levels_have_no_label(spark):
    levels = spark.createDataFrame([(1, 0, "a", 1, None, "decimal", "%1.", False, False)], "instance long, level int, list string, start long, restart long, format string, text string, legal boolean, override boolean")
    items = spark.createDataFrame([(1, k, i, lv) for k, (i, lv) in enumerate([(1, 0), (1, 5), (9, 0), (1, 0), (None, None)])], "doc long, o long, instance long, level int")
    assert values(list_items(items, ["doc"], ["o"], levels), "o", "number", "label") == [(0, 1, "1."), (1, None, None), (2, None, None), (3, 2, "2."), (4, None, None)]
    assert list_items(items.where("false"), ["doc"], ["o"], levels).count() == 0


def test_packages_are_scanned_once_and_only_kinds_asked_for_leave_the_worker(spark, sf_dir):
    files = contents(spark, sf_dir)
    assert {r.kind for r in scan_contents(files, ("style", "pages")).collect()} == {"style", "pages"}
    assert values(scan_contents(files, ("style",)), "path", "name") == values(scan_contents(files).where("kind = 'style'"), "path", "name")
    assert "MapInArrow" not in scanned(spark, sf_dir, "style")._jdf.queryExecution().toString()


def test_partitions_grow_with_the_rows(spark, sf_dir):
    rows = spark.range(4000).withColumn("k", F.col("id") % 400)
    found = dealt(rows, ["k"], rows=100)
    assert found.rdd.getNumPartitions() == 40 and found.count() == 4000
    assert found.groupBy("k", F.spark_partition_id()).count().count() == 400
    assert dealt(rows, ["k"]).rdd.getNumPartitions() == 8
    for name in ("footnote_places", "table_cascade"):
        assert "REPARTITION_BY_NUM" in QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
