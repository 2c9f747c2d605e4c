"""One fold of a document's blocks into pages: words beside obstacles, boxes, notes at the foot, keeps; resumable by page.

A page is scanned from the state it begins with (position and notes that go on) until something doesn't fit; then the break moves back as the keeps
ask. The state of every page is kept with its rows, so a changed document is folded again from the first page that had
looked at a changed block, until a page begins as an old one did.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import islice
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators.rounds import cut


class Rules(NamedTuple):
    """Column width, lines of a page, narrowest segment used, lines that stay together at a split, lines of the notes' separator."""

    width: int
    room: int
    least: int = 8
    widows: int = 2
    separator: int = 1


class Block(NamedTuple):
    """Words (lengths) or a box; notes as (word, lines); an obstacle (left, right, height, lines below the block's top)."""

    words: Sequence[int] = ()
    notes: Sequence[tuple[int, int]] = ()
    obstacle: tuple[int, int, int, int] | None = None
    box: tuple[int, int] | None = None
    keep_lines: bool = False
    keep_next: bool = False
    break_before: bool = False


class Note(NamedTuple):
    """A note, by the block and word it belongs to, from line ``next`` of ``lines``."""

    block: int
    word: int
    next: int
    lines: int


class State(NamedTuple):
    """What a page begins with."""

    page: int
    block: int
    word: int
    carry: tuple[Note, ...] = ()


class Row(NamedTuple):
    """A segment of a line, a box, an obstacle, or lines of a note.

    first and count are words, or lines of the note, or width and height of the obstacle; y counts from the page's top, for notes from the top of theirs.
    """

    page: int
    kind: str
    block: int
    first: int
    count: int
    y: int
    x: int


class _Line(NamedTuple):
    block: int
    first: int
    rows: list[Row]
    bottom: int
    before: tuple[int, int, tuple[Note, ...]]


def free_spans(obstacles: Sequence[tuple[int, int, int, int]], top: int, bottom: int, width: int) -> tuple[list[tuple[int, int]], int | None]:
    """What obstacles (top, bottom, left, right) leave of [0, width) between two heights, and where the first of them ends."""
    near = sorted((o for o in obstacles if o[0] < bottom and o[1] > top), key=lambda o: o[2])
    spans, at = [], 0
    for _, _, left, right in near:
        if left > at:
            spans.append((at, left))
        at = max(at, right)
    if at < width:
        spans.append((at, width))
    return spans, min((o[1] for o in near), default=None)


def set_line(words: Sequence[int], at: int, spans: Sequence[tuple[int, int]], forced: bool) -> list[tuple[int, int, int]]:
    """(x, first word, words) of a line over spans, from left to right; a span that can't hold the next word is passed over. Forced: one word is always set."""
    out = []
    for left, right in spans:
        pen, first = 0, at
        while at < len(words) and pen + (pen > 0) + words[at] <= right - left:
            pen, at = pen + (pen > 0) + words[at], at + 1
        if forced and at == first and at < len(words) and not out:
            at += 1
        if at > first:
            out.append((left, first, at - first))
    return out


def note_part(note: Note, room: int, widows: int) -> int:
    """The most lines of a note that go in the room, ``widows`` staying together on each side of a split."""
    rest = note.lines - note.next
    most = min(rest, room)
    if most < rest:
        most = min(most, rest - widows)
        if note.next + most < widows:
            most = 0
    return max(most, 0)


def note_least(note: Note, widows: int) -> int:
    """The fewest lines of a new note that may stand on its page."""
    return widows if note.lines >= 2 * widows else note.lines


class _Page:
    """A page being filled."""

    def __init__(self, page: int, rules: Rules):
        self.page, self.rules = page, rules
        self.y = self.foot = 0
        self.queue: tuple[Note, ...] = ()
        self.notes: list[Row] = []
        self.lines: list[_Line] = []
        self.obstacles: list[tuple[int, int, int, int]] = []

    def drain(self, room: int, forced: bool = False) -> None:
        """Set waiting notes, in order, in the room that is left, the separator before the first."""
        while self.queue:
            note, line = self.queue[0], 0 if self.foot else self.rules.separator
            left = room - self.foot - line
            part = note_part(note, left, self.rules.widows)
            if forced and not part and not self.foot:
                part = max(min(left, note.lines - note.next), 1)
            if not part:
                return
            self.notes.append(Row(self.page, "note", note.block, note.next, part, self.foot + line, note.word))
            self.foot += line + part
            done = note.next + part == note.lines
            self.queue = self.queue[1:] if done else (note._replace(next=note.next + part), *self.queue[1:])
            if not done:
                return

    def drop_from(self, k: int) -> None:
        """Take back the lines from the k-th on, with their notes."""
        if k < len(self.lines):
            self.foot, n, self.queue = self.lines[k].before
            del self.notes[n:]
            del self.lines[k:]
        self.y = self.lines[-1].bottom if self.lines else 0


def _placed(page: _Page, block: Block, at: int) -> tuple[int, int, list[tuple[int, int, int]]]:
    """Top, height and segments of a block's next line, or of its box, below the obstacles that leave it no room."""
    rules, y = page.rules, page.y
    while True:
        height = block.box[1] if block.box else 1
        spans, below = free_spans(page.obstacles, y, y + height, rules.width)
        if block.box:
            found = [(left, 0, 0) for left, right in spans if right - left >= block.box[0]][:1]
        elif below is None:
            found = set_line(block.words, at, [(0, rules.width)], True)
        else:
            found = set_line(block.words, at, [s for s in spans if s[1] - s[0] >= rules.least], False)
        if found or below is None:
            return y, height, found or [(0, at, 0)]
        if not block.words and not block.box and any(s[1] - s[0] >= rules.least for s in spans):
            return y, height, [(next(s[0] for s in spans if s[1] - s[0] >= rules.least), at, 0)]
        y = below


def _rest(words: Sequence[int], at: int, width: int, most: int) -> int:
    """Lines at full width from a word on, counted up to ``most``."""
    lines = 0
    while at < len(words) and lines < most:
        at, lines = at + sum(n for _, _, n in set_line(words, at, [(0, width)], True)), lines + 1
    return lines


def _break(page: _Page, blocks: Sequence[Block], b: int, word: int) -> tuple[int, int, int]:
    """Where the next page begins (block, word) and the first line that goes there, when the line at (b, word) doesn't fit."""
    lines, rules, block = page.lines, page.rules, blocks[b]
    own = sum(line.block == b for line in lines)
    began = word == 0 or any(line.block == b and line.first == 0 for line in lines)
    stay = own
    if word:
        rest = _rest(block.words, word, rules.width, rules.widows)
        stay = own - max(rules.widows - rest, 0)
        if began and (stay < rules.widows or (block.keep_lines and own < len(lines))):
            stay = 0
        if stay <= 0 and (not began or own == len(lines)):
            return b, word, len(lines)  # the page would be empty: no keep counts
        if stay > 0:
            k = len(lines) - own + stay
            return b, lines[k].first if k < len(lines) else word, k
    back = b
    while back > lines[0].block and blocks[back - 1].keep_next:
        back -= 1
    first = lambda t: next((k for k, line in enumerate(lines) if line.block == t), len(lines))
    if back == lines[0].block:
        back = b  # nothing, or only the end of a block, would stay on the page
    return back, 0, first(back)


def scan_page(blocks: Sequence[Block], state: State, rules: Rules) -> tuple[list[Row], State | None, int]:
    """Rows of a page, the state of the next one (None after the last) and the last block looked at (their number, if all were)."""
    page, (b, word) = _Page(state.page, rules), (state.block, state.word)
    page.queue = state.carry
    page.drain(rules.room - (1 if b < len(blocks) else 0), forced=True)
    to = None
    looked = b
    while b < len(blocks):
        looked = b
        block, first = blocks[b], word == 0
        if first and block.break_before and page.lines:
            to = (b, 0, len(page.lines))
            break
        fits, beside = True, []
        if first and block.obstacle:
            left, right, height, down = block.obstacle
            fits = page.y + down + height + page.foot <= rules.room
            page.obstacles.append((page.y + down, min(page.y + down + height, rules.room), left, right))
            beside = [Row(state.page, "obstacle", b, right - left, page.obstacles[-1][1] - page.y - down, page.y + down, left)]
        y, height, segments = _placed(page, block, word)
        end = word + sum(n for _, _, n in segments)
        notes = [Note(b, w, 0, n) for w, n in block.notes if word <= w < end and n > 0]
        least = sum(n.lines for n in notes[:-1]) + note_least(notes[-1], rules.widows) + (0 if page.foot else rules.separator) if notes else 0
        fits &= y + height + page.foot + least <= rules.room and not (notes and page.queue)
        if not fits and page.lines:
            to = _break(page, blocks, b, word)
            break
        kind = "box" if block.box else "line"
        rows = beside + [Row(state.page, kind, b, at, n, y, x) for x, at, n in segments]
        page.lines.append(_Line(b, word, rows, y + height, (page.foot, len(page.notes), page.queue)))
        page.y = y + height
        page.queue += tuple(notes)
        page.drain(rules.room - page.y)
        b, word = (b + 1, 0) if end >= len(block.words) else (b, end)
        page.obstacles = [o for o in page.obstacles if o[1] > page.y]
    else:
        looked = len(blocks)
        to = (b, 0, len(page.lines))
    b, word, k = to
    page.drop_from(k)
    page.drain(rules.room - page.y)
    rows = [row for line in page.lines for row in line.rows] + page.notes
    return rows, State(state.page + 1, b, word, page.queue) if b < len(blocks) or page.queue else None, looked


def fold(blocks: Sequence[Block], rules: Rules, start: State | None = State(1, 0, 0), known: dict[tuple[int, int], int] | None = None, shift: int = 0, tail: int | None = None) -> tuple[list[tuple[State, int, list[Row]]], tuple[int, int] | None]:
    """Pages as (state, last block looked at, rows) from a state on.

    Stops where a page would begin, without notes that go on, at a block of the unchanged ``tail`` at which an old page began (``known``: (block - shift, word) ->
    page): then (new page, old page) is the second result.
    """
    out, state = [], start if blocks else None
    while state is not None:
        if known and out and not state.carry and tail is not None and state.block >= tail and (old := known.get((state.block - shift, state.word))):
            return out, (state.page, old)
        rows, after, looked = scan_page(blocks, state, rules)
        out.append((state, looked, rows))
        state = after
    return out, None


#: Columns of a block; notes are (word, lines).
BLOCK = "struct<words:array<int>,notes:array<struct<word:int,lines:int>>,obstacle:struct<left:int,right:int,height:int,down:int>,box:struct<width:int,height:int>,keep_lines:boolean,keep_next:boolean,break_before:boolean>"
_CARRY = "array<struct<block:long,word:long,next:long,lines:long>>"
SCHEMA = f"doc_id long, page long, kind string, block long, first long, count long, y long, x long, carry {_CARRY}"
_NAMES = ["doc_id", "page", "kind", "block", "first", "count", "y", "x", "carry"]


def block(words: Column | None = None, notes: Column | None = None, obstacle: Column | None = None, box: Column | None = None, keep_lines: Column | None = None, keep_next: Column | None = None, break_before: Column | None = None) -> Column:
    """A block of the fold; what isn't given is absent."""
    given = (words, notes, obstacle, box, keep_lines, keep_next, break_before)
    names = ("words", "notes", "obstacle", "box", "keep_lines", "keep_next", "break_before")
    return F.struct(*((F.lit(None) if c is None else c).alias(n) for c, n in zip(given, names, strict=True))).cast(BLOCK)


#: Documents whose blocks are unpacked, and rows that leave a worker, at a time.
BATCH_DOCS, BATCH_ROWS = 64, 5000


def _plain(column: pa.Array) -> list:
    return column.to_pylist() if column.null_count < len(column) else [None] * len(column)


def _blocks(lists: pa.ListArray) -> Iterator[list[Block]]:
    """The blocks of every document, column by column; a null list is empty."""
    words, notes, obstacles, boxes, *keeps = (_plain(c) for c in lists.flatten().flatten())
    told = [
        Block(w or (), [(x["word"], x["lines"]) for x in n] if n else (), o and (o["left"], o["right"], o["height"], o["down"]), x and (x["width"], x["height"]), bool(lines), bool(after), bool(before))
        for w, n, o, x, lines, after, before in zip(words, notes, obstacles, boxes, *keeps, strict=True)
    ]
    at = 0
    for n in lists.value_lengths().to_pylist():
        yield told[at : at + (n or 0)]
        at += n or 0


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(at, BATCH_DOCS) for at in range(0, batch.num_rows, BATCH_DOCS))


def _rows(doc_id: int, pages: list[tuple[State, int, list[Row]]], more: Sequence[tuple] = ()) -> Iterator[tuple]:
    for r in more:
        yield (doc_id, *r, None)
    for state, looked, own in pages:
        yield (doc_id, state.page, "page", state.block, state.word, looked, None, None, [n._asdict() for n in state.carry])
        for r in own:
            yield (doc_id, *r, None)


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of many documents in each batch: short documents don't cost a batch of their own."""
    long, carry = pa.int64(), pa.list_(pa.struct([(c, pa.int64()) for c in Note._fields]))
    kinds = [long, long, pa.string(), long, long, long, long, long, carry]
    while some := list(islice(rows, BATCH_ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*some, strict=True), kinds, strict=True)], names=_NAMES)


def page_fold(documents: DataFrame, rules: Rules) -> DataFrame:
    """All rows of all pages of (doc_id, blocks): kind ``line`` (a segment), ``box``, ``obstacle``, ``note`` (x: the word it belongs to), and one ``page`` for each page's state.

    Words are set greedily. An obstacle stands where its block begins; lines go beside it in every segment of ``least`` or more, boxes in the first that holds
    them, and below it where there is none. A line stands with the beginning of its notes (``widows`` lines) at least; the rest goes on at
    the foot of the next pages, before theirs, and has pages of its own at the end. An obstacle or a line that doesn't fit goes to the next page: ``widows`` lines
    stay on each side of a split, a block that keeps its lines moves whole, and takes along those before it that keep with it;
    none of this counts where it would leave a page empty. A null or empty list of blocks gives no rows. A document is one row, so nothing is shuffled.
    A column ``room``, where there is one, has each document's own lines of a page.
    """
    own = F.col("room").cast("long") if "room" in documents.columns else F.lit(None).cast("long")

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in _slices(batches):
            for doc_id, blocks, room in zip(batch.column(0).to_pylist(), _blocks(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                yield from _rows(doc_id, fold(blocks, rules if room is None else rules._replace(room=room))[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(folded(batches))

    return documents.select("doc_id", F.col("blocks").cast(f"array<{BLOCK}>"), own).mapInArrow(run, SCHEMA)


def with_stories(documents: DataFrame, rules: Rules, height: Callable[[Column], Column], most: int = 4) -> DataFrame:
    """(doc_id, pages, story, passes, settled): documents whose header is as high as the number of pages makes it, and takes that room from every page.

    ``height``: the header's lines from the number of pages. Pages are folded with the room that the last number of pages leaves until it comes back, ``most`` times at the utmost; then the last one stands,
    unsettled. Only documents that haven't settled are folded again. A header leaves one line of a page at least.
    """
    now = cut(documents.select("doc_id", "blocks", F.lit(1).cast("long").alias("n")))
    out: list[DataFrame] = []
    for passes in range(1, most + 1):
        story = F.least(height(F.col("n")), F.lit(rules.room - 1)).cast("long")
        asked = now.withColumn("story", story).withColumn("room", rules.room - F.col("story"))
        found = page_fold(asked.select("doc_id", "blocks", "room"), rules).groupBy("doc_id").agg(F.max("page").alias("pages"))
        step = cut(asked.join(found, "doc_id").withColumn("settled", F.col("pages") == F.col("n")))
        done = step if passes == most else step.where("settled")
        out.append(done.select("doc_id", "pages", "story", F.lit(passes).alias("passes"), "settled"))
        now = step.where("NOT settled").select("doc_id", "blocks", F.col("pages").alias("n"))
        if passes == most or now.isEmpty():
            break
    return reduce(DataFrame.unionByName, out)


def resumed(old: DataFrame, new: DataFrame, folded: DataFrame, rules: Rules) -> DataFrame:
    """``page_fold(new)`` from ``folded``, which is page_fold(old), with ``source``: kept, fresh or spliced.

    Of a changed document pages are folded from the first that had looked at a changed block on, until one begins where an old one did in
    the part after the last change; pages before are kept, pages after are the old ones with new numbers. Only fresh pages cost work.
    """
    a, b = old.select("doc_id", F.col("blocks").cast(f"array<{BLOCK}>").alias("a")), new.select("doc_id", F.col("blocks").cast(f"array<{BLOCK}>").alias("b"))
    equal = lambda x, y: F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), F.lit(False)) - 1
    both = b.join(a, "doc_id", "left").withColumn("a", F.coalesce("a", F.array().cast(f"array<{BLOCK}>"))).withColumn("b", F.coalesce("b", F.array().cast(f"array<{BLOCK}>")))
    both = both.withColumn("head", equal("a", "b")).where("head >= 0")
    both = both.withColumn("tail", F.least(F.when(equal(F.reverse("a"), F.reverse("b")) < 0, F.least(F.size("a"), F.size("b"))).otherwise(equal(F.reverse("a"), F.reverse("b"))), F.least(F.size("a"), F.size("b")) - F.col("head")))
    state = F.struct("page", "block", F.col("first").alias("word"), F.col("count").alias("looked"), "carry")
    states = folded.where("kind = 'page'").groupBy("doc_id").agg(F.array_sort(F.collect_list(state)).alias("states"))
    told = both.join(states, "doc_id", "left").select("doc_id", "b", "head", "tail", F.size("a").alias("was"), "states")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in _slices(batches):
            ids, _, *others = batch.columns
            for doc_id, blocks, head, tail, was, states_ in zip(ids.to_pylist(), _blocks(batch.column(1)), *(c.to_pylist() for c in others), strict=True):
                shift = len(blocks) - was
                states = [(State(s["page"], s["block"], s["word"], tuple(Note(**n) for n in s["carry"])), s["looked"]) for s in states_ or ()]
                start = next((s for s, looked in states if looked >= head), State(1, 0, 0))
                known = {(s.block, s.word): s.page for s, _ in states if not s.carry}
                pages, met = fold(blocks, rules, start, known, shift, len(blocks) - tail)
                # Of the old pages: kept before the first, then from ``first`` on with page + y and block + block.
                yield from _rows(doc_id, pages, [(start.page, "plan", shift, met[1] if met else None, len(pages), met[0] - met[1] if met else None, None)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(again(batches))

    found = cut(told.mapInArrow(run, SCHEMA))
    plan = found.where("kind = 'plan'").select("doc_id", F.col("page").alias("from"), F.col("block").alias("shift"), F.col("first").alias("met"), F.col("y").alias("later"))
    still = folded.join(new.select("doc_id"), "doc_id", "left_semi").join(plan, "doc_id", "left")
    kept = still.where(F.col("from").isNull() | (F.col("page") < F.col("from"))).select(*_NAMES, F.lit("kept").alias("source"))
    moved = still.where(F.col("page") >= F.col("met")).withColumn("page", F.col("page") + F.col("later")).withColumn("block", F.col("block") + F.col("shift"))
    moved = moved.withColumn("count", F.when(F.col("kind") == "page", F.col("count") + F.col("shift")).otherwise(F.col("count")))
    moved = moved.withColumn("carry", F.transform("carry", lambda n: n.withField("block", n["block"] + F.col("shift"))))
    fresh = found.where("kind <> 'plan'").select(*_NAMES, F.lit("fresh").alias("source"))
    return kept.unionByName(fresh).unionByName(moved.select(*_NAMES, F.lit("spliced").alias("source")))
