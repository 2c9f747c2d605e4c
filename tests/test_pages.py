"""The page fold against plainer folds, a painted page, and itself after edits."""

import random

import pytest
from pyspark.sql import functions as F

from strata.operators import pages
from strata.operators.fold import fold_pages
from strata.operators.pages import Block, Note, Rules, State, fold, free_spans, note_least, note_part, page_fold, resumed


def flat(found):
    return [row for _, _, rows in found for row in rows]


@pytest.mark.parametrize("seed", range(200))
def test_keeps_alone_are_those_of_the_plain_fold(seed):
    rng = random.Random(seed)
    room, widows = rng.choice([5, 8, 20]), rng.choice([1, 2, 3])
    told = [(k, rng.randint(1, 12), rng.random() < 0.3, rng.random() < 0.3, rng.random() < 0.05) for k in range(rng.randint(1, 30))]
    found, _ = fold([Block([10] * n, keep_lines=kl, keep_next=kn, break_before=br) for _, n, kl, kn, br in told], Rules(10, room, widows=widows))
    got = {}
    for r in flat(found):
        got.setdefault((r.block, r.page), []).append(r.first)
    pieces = sorted((b, min(f), len(f), p) for (b, p), f in got.items())
    assert pieces == sorted(fold_pages(told, room, widows))


def document(rng, blocks=25):
    """Blocks with all that the fold knows."""
    out = []
    for _ in range(rng.randint(0, blocks)):
        words = [rng.randint(1, 14) for _ in range(rng.choice([0, 1, 8, 40]))]
        notes = [(w, rng.randint(1, 9)) for w in sorted(rng.sample(range(len(words)), min(len(words), rng.choice([0, 0, 1, 3]))))]
        left = rng.choice([0, 20, 12])
        obstacle = (left, left + rng.randint(1, 20), rng.randint(1, 6), rng.choice([0, 0, 2])) if rng.random() < 0.25 else None
        box = (rng.randint(1, 40), rng.randint(1, 7)) if rng.random() < 0.15 else None
        out.append(Block([] if box else words, [] if box else notes, obstacle, box, rng.random() < 0.2, rng.random() < 0.2, rng.random() < 0.05))
    return out


@pytest.mark.parametrize("seed", range(150))
def test_pages_are_whole_and_nothing_overlaps(seed):
    """Every word once and in order, every note whole and in order, each page painted cell by cell without a clash."""
    rng = random.Random(seed)
    rules, blocks = Rules(40, rng.choice([12, 20]), widows=rng.choice([1, 2])), document(rng)
    found, _ = fold(blocks, rules)
    rows = flat(found)
    body = [r for r in rows if r.kind in ("line", "box")]
    assert [w for r in body if r.kind == "line" for w in [(r.block, r.first + k) for k in range(r.count)]] == [(b, w) for b, own in enumerate(blocks) for w in range(len(own.words))]
    assert [r.block for r in body if r.kind == "box"] == [b for b, own in enumerate(blocks) if own.box]
    parts = {}
    for r in rows:
        if r.kind == "note":
            parts.setdefault((r.block, r.x), []).append((r.page, r.first, r.count))
    assert sorted(parts) == sorted((b, w) for b, own in enumerate(blocks) for w, _ in own.notes)
    for (b, w), own in parts.items():
        lines = dict(blocks[b].notes)[w]
        assert [f for _, f, _ in own] == [sum(c for _, _, c in own[:k]) for k in range(len(own))] and sum(c for *_, c in own) == lines
        home = next(r.page for r in body if r.block == b and r.first <= w < r.first + r.count)
        assert own[0][0] >= home
    for _, _, page in found:
        cells, kept_off, tall = set(), set(), 0
        for r in page:
            if r.kind == "note":
                tall = max(tall, r.y + r.count)
                continue
            size = {"box": blocks[r.block].box, "obstacle": (r.first, r.count)}.get(r.kind) or (sum(blocks[r.block].words[r.first : r.first + r.count]) + max(r.count - 1, 0), 1)
            new = {(y, x) for y in range(r.y, r.y + size[1]) for x in range(r.x, r.x + size[0])}
            if r.kind == "obstacle":
                kept_off |= new
                assert r.y + r.count <= rules.room
            else:
                assert not new & cells
                cells |= new
        assert not cells & kept_off
        low = max((y for y, _ in cells), default=-1) + 1
        assert low + tall <= rules.room or len({(r.block, r.first) for r in page if r.kind in ("line", "box")}) <= 1


def test_lines_beside_obstacles_against_a_painted_page():
    """One block of words after an obstacle: every line takes what is free of its row, cell by cell."""
    for seed in range(100):
        rng = random.Random(seed)
        words = [rng.randint(1, 9) for _ in range(120)]
        obstacles = [(x := rng.randrange(0, 36), min(40, x + rng.randint(1, 30)), rng.randint(1, 5), rng.randint(0, 4)) for _ in range(3)]
        blocks = [Block(box=(0, 0), obstacle=o) for o in obstacles] + [Block(words)]
        rows = [r for r in flat(fold(blocks, Rules(40, 10**6, least=6, widows=1))[0]) if r.kind == "line"]
        taken = {(y, x) for left, right, height, down in obstacles for y in range(down, down + height) for x in range(left, right)}
        at, want, y = 0, [], 0
        while at < len(words):
            row = "".join("#" if (y, x) in taken else "." for x in range(40))
            x = 0
            while x < 40:
                if row[x] == "#":
                    x += 1
                    continue
                end = x
                while end < 40 and row[end] == ".":
                    end += 1
                pen, first = x, at
                while end - x >= 6 and at < len(words) and pen + (pen > x) + words[at] <= end:
                    pen += (pen > x) + words[at]
                    at += 1
                if at > first:
                    want.append((3, first, at - first, y, x))
                x = end
            y += 1
        # A line that finds no room drops to the foot of an obstacle, so it may skip rows that the painted page leaves empty too.
        assert [(r.block, r.first, r.count, r.y, r.x) for r in rows] == want


def test_notes_split_where_lines_stay_together():
    for lines in range(1, 12):
        for widows in (1, 2, 3):
            allowed = [k for k in range(1, lines + 1) if k == lines or (k >= widows and lines - k >= widows)]
            assert note_least(Note(0, 0, 0, lines), widows) == allowed[0]
            for room in range(14):
                assert note_part(Note(0, 0, 0, lines), room, widows) == max([k for k in allowed if k <= room], default=0)
    assert free_spans([(0, 2, 5, 10), (1, 3, 8, 12)], 0, 2, 20) == ([(0, 5), (12, 20)], 2)
    found, _ = fold([Block([5], [(0, 30)])], Rules(10, 12))
    assert [(r.page, r.first, r.count, r.y) for r in flat(found) if r.kind == "note"] == [(1, 0, 10, 1), (2, 10, 11, 1), (3, 21, 9, 1)]


@pytest.mark.parametrize("seed", range(150))
def test_resumed_pages_are_those_of_a_whole_fold(seed):
    rng = random.Random(seed)
    rules, old = Rules(40, 14), document(rng, 60)
    new = list(old)
    for _ in range(rng.choice([1, 1, 2])):
        k, what = rng.randrange(len(new) + 1), rng.choice(["insert", "remove", "change"])
        new[k : k + (what != "insert")] = [] if what == "remove" else document(rng, 3)
    before, _ = fold(old, rules)
    head = next((k for k, (a, b) in enumerate(zip(old, new, strict=False)) if a != b), min(len(old), len(new)))
    tail = next((k for k, (a, b) in enumerate(zip(old[::-1], new[::-1], strict=False)) if a != b), min(len(old), len(new)))
    tail = min(tail, min(len(old), len(new)) - head)
    start = next((s for s, looked, _ in before if looked >= head), State(1, 0, 0))
    known = {(s.block, s.word): s.page for s, _, _ in before if not s.carry}
    fresh, met = fold(new, rules, start, known, len(new) - len(old), len(new) - tail)
    spliced = [] if met is None else [r._replace(page=r.page + met[0] - met[1], block=r.block + len(new) - len(old)) for s, _, rows in before if s.page >= met[1] for r in rows]
    assert [r for s, _, rows in before if s.page < start.page for r in rows] + flat(fresh) + spliced == flat(fold(new, rules)[0])


def rows_of(docs):
    out = []
    for i, blocks in docs:
        out.append((i, None if blocks is None else [(b.words, b.notes, b.obstacle, b.box, b.keep_lines, b.keep_next, b.break_before) for b in blocks]))
    return out


def test_only_reached_pages_are_folded_again(spark, monkeypatch):
    rng = random.Random(9)
    rules = Rules(40, 14)
    old = [(i, document(rng, 80)) for i in range(30)] + [(30, None), (31, []), (32, document(rng, 40))]
    new = [(i, d if not d or i % 3 == 0 else [*d[: len(d) // 2], *document(rng, 2), *d[len(d) // 2 + 1 :]]) for i, d in old if i != 32] + [(33, document(rng, 20))]
    schema = f"doc_id long, blocks array<{pages.BLOCK}>"
    a, b = (spark.createDataFrame(rows_of(d), schema) for d in (old, new))
    names = ["doc_id", "page", "kind", "block", "first", "count", "y", "x", "carry"]
    key = lambda r: (r.doc_id, r.page, r.kind != "page", repr(tuple(r)))
    folded = page_fold(a, rules).cache()
    found = resumed(a, b, folded, rules).cache()
    whole = page_fold(b, rules).collect()
    assert sorted(found.select(*names).collect(), key=key) == sorted(whole, key=key)
    pages_by = {r["source"]: r["n"] for r in found.where("kind = 'page'").groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert pages_by["fresh"] < 0.5 * sum(pages_by.values()) and pages_by["spliced"] > 20 and pages_by["kept"] > 20
    changed = {i for (i, d), (_, e) in zip(old, new, strict=False) if d != e} | {33}
    assert {r.doc_id for r in found.where("source <> 'kept'").collect()} <= changed


def test_short_documents_share_batches(spark):
    given = [(k, [([5, 5], None, None, None, False, False, False), ([], None, (0, 3, 2, 0), (4, 2), None, None, None)]) for k in range(300)] + [(300, None), (301, [])]
    docs = spark.createDataFrame(given, f"doc_id long, blocks array<{pages.BLOCK}>").coalesce(1)
    rows = [r for d in range(300) for r in pages._rows(d, pages.fold([pages.Block([5, 5]), pages.Block((), (), (0, 3, 2, 0), (4, 2))], pages.Rules(12, 6))[0])]
    sizes = [b.num_rows for b in pages._batches(iter(rows))]
    assert len(sizes) == -(-len(rows) // pages.BATCH_ROWS)
    found = [tuple(r)[:8] for r in pages.page_fold(docs, pages.Rules(12, 6)).collect()]
    assert sorted(found, key=repr) == sorted((tuple(r)[:8] for r in rows), key=repr)
