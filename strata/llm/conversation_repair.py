"""Repair of conversations' structure at least cost, with every edit."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.mixing import numbered
from strata.llm.repair_automaton import COST, DUE, EDITS, FAULTS, INSERT, KEEP, KEPT, LAST, RENAME, ROLES, TRUNCATED, Automaton, before
from strata.llm.staging import Stage

#: Rows of a conversation that are scanned as one piece.
PIECE = 4096
#: Rows and bytes of text in a batch that is sent on.
ROWS, BYTES = 4096, 4 << 20
_SPACES = " \t\n\u000b\f\r"
_NAMES = ("user", "assistant")


def damage_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults put in by crc32 of ``conv:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 takes ``.``, ``!`` and ``?`` out of it, 3 gives the row twice, 4 sets its role to user. A null role, text,
    or part of the hashed key counts as one space.
    """
    blank = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank(conv_col), F.lit(":"), blank(turn_col)).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(blank(text_col), ".!?", "")).otherwise(blank(text_col))
    out = rows.where(kind != 0).select(rows[conv_col].alias("conv_id"), rows[turn_col].alias("turn"), F.when(kind == 4, "user").otherwise(blank(role_col)).alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("copies"))
    return out.withColumn("copies", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies")


def _keyed(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """g (the conversation, never null), conv, turn, role, text, and h, by which rows are ordered after turn and role."""
    blank = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    group: Column = F.coalesce(F.concat(F.lit("="), rows[conv_col].cast("string")), F.lit(""))
    return rows.select(group.alias("g"), rows[conv_col].alias("conv"), rows[turn_col].alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text")).withColumn("h", F.unhex(F.md5(F.col("text").cast("binary"))))


def _pieces(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all pieces of a batch, and their offsets."""
    lists = batch.column(column)
    offsets = lists.offsets.to_numpy()
    return lists.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int64), (offsets - offsets[0]).astype(np.int64)


def _edit_codes(keyed: DataFrame, stage: Stage) -> DataFrame:
    """For every piece of a conversation: g, piece, the place (turn, role, h) of its first row, faults, codes of its rows' edits and, of the first, the cost of all.

    Rows are numbered over ranges of (conversation, turn, role, text hash), so a long conversation is spread over tasks like any other; a piece of it is
    summed up as a 4 x 4 matrix, and only these meet in one task.
    """
    bare = F.expr(f"trim(trailing '{_SPACES}' from text)")
    own = keyed.select("g", "turn", "role", "h", (F.length(bare) == 0).alias("blank"), F.right(bare, F.lit(1)).isin(".", "!", "?").alias("ended"))
    own = stage.put(numbered(own, stage, "ranges", "g", ["turn", "role", "h"]), "numbered")
    first = own.groupBy("g", "role", "h").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    initial = F.substring("role", 1, 1)
    role = F.when(initial == ROLES[0], 0).when(initial == ROLES[1], 1).when(initial == ROLES[2], 2).otherwise(3)
    fault = F.when(F.col("blank"), 1).when(F.col("n") > F.col("first"), 2).when(~F.col("ended"), 3).otherwise(0)
    rows = own.join(first, ["g", "role", "h"], "left").select("g", "n", F.struct("turn", "role", "h").alias("place"), (role + 4 * fault).cast("tinyint").alias("symbol"))
    pieces = rows.groupBy("g", F.expr(f"n div {PIECE}").alias("piece")).agg(F.sort_array(F.collect_list(F.struct("n", "symbol"))).alias("rows"), F.min_by("place", "n").alias("place"))
    pieces = pieces.select("g", "piece", "place", F.col("rows.symbol").alias("symbols"))
    place = pieces.schema["place"].dataType.simpleString()

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Automaton()
        for batch in batches:
            flat = made.matrices(*_pieces(batch, "symbols")).reshape(-1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.FixedSizeListArray.from_arrays(pa.array(flat), 16).cast(pa.list_(pa.int64()))], names=["g", "piece", "place", "symbols", "matrix"])

    pieces = stage.put(pieces.mapInArrow(sum_up, f"g string, piece long, place {place}, symbols array<tinyint>, matrix array<long>"), "pieces")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces come conversation by conversation, from last to first."""
        at, after = None, np.array(LAST)
        for batch in batches:
            out, costs = [], []
            for g, piece, matrix in zip(batch.column("g").to_pylist(), batch.column("piece").to_pylist(), np.array(batch.column("matrix").flatten()).reshape(-1, 4, 4), strict=True):
                if g != at:
                    at, after = g, np.array(LAST)
                out.append(after.tolist())
                after = before(matrix, after)
                costs.append(int(after[0]) if piece == 0 else None)
            yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("piece"), pa.array(out, pa.list_(pa.int64())), pa.array(costs, pa.int64())], names=["g", "piece", "after", "cost"])

    order = pieces.select("g", "piece", "matrix").repartition("g").sortWithinPartitions("g", F.desc("piece"))
    after = order.mapInArrow(chain, "g string, piece long, after array<long>, cost long")

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Automaton()
        for batch in batches:
            symbols, offsets = _pieces(batch, "symbols")
            states = np.array([made.state(v)[0] for v in batch.column("after").to_pylist()], np.int64)
            kept = np.zeros(len(symbols), np.int64)
            made.scan(symbols, offsets, states, kept)
            codes = made.trace(symbols, offsets, kept)
            bounds = list(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
            faults = symbols.astype(np.uint8) // len(ROLES)
            packed = [pa.array([x[a:b].tobytes() for a, b in bounds], pa.binary()) for x in (faults, codes)]
            yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("piece"), batch.column("place"), batch.column("cost"), *packed], names=["g", "piece", "place", "total", "faults", "codes"])

    joined = pieces.select("g", "piece", "place", "symbols").join(after, ["g", "piece"])
    return joined.mapInArrow(edits, f"g string, piece long, place {place}, total long, faults binary, codes binary")


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Every edit that repairs the conversations at least cost: conv_id, turn, edit, old_role, role, text, fault, cost, total.

    A conversation's rows are taken by turn (null first), then by role and the MD5 of the text. A row is blank (nothing but white space), else duplicate (its role and text came before in
    the conversation), else truncated (its last character that isn't white space is none of ``.!?``), else without fault. Edits are K (keep), R (set the role to
    user or assistant, cost 1), D (delete, 2; blank and duplicate rows must go) and I (insert an empty user or assistant row, 5); a truncated row that stays
    costs 5 more. The roles' first letters of what stays fit ``(s?(ua)+)?``. Of edits that cost the same, those whose letters come first in ASCII order are taken.
    ``cost`` is the edit's own, ``total`` the conversation's. A deleted row keeps its old role; an inserted one has no turn, old role or fault.

    The rows of one conversation come in order, all in one partition: they pass through one task as a stream there, since whatever reads a conversation in order needs them so; the
    search for the edits is spread over pieces of PIECE rows, and no conversation is held in memory.
    Null roles and texts count as one space, a null conversation is one like any other, repeated rows are duplicates, an empty table gives no rows; other columns are not read.
    """
    stage = Stage(rows.sparkSession, "conversation_repair")
    keyed = _keyed(rows, conv_col, turn_col, role_col, text_col)
    codes = _edit_codes(keyed, stage)
    conv, turn = (keyed.schema[c].dataType.simpleString() for c in ("conv", "turn"))
    nothing = lambda kind: F.lit(None).cast(kind)
    marks = codes.select("g", nothing(conv).alias("conv"), F.col("place.turn").alias("turn"), F.col("place.role").alias("role"), F.col("place.h").alias("h"), F.lit(0).alias("kind"), nothing("string").alias("text"), "piece", "total", "faults", "codes")
    texts = keyed.select("g", "conv", "turn", "role", "h", F.lit(1).alias("kind"), "text", *(nothing(k).alias(c) for c, k in (("piece", "long"), ("total", "long"), ("faults", "binary"), ("codes", "binary"))))
    both = marks.unionByName(texts).repartition("g").sortWithinPartitions("g", "turn", "role", "h", "kind", "piece").drop("h", "piece")
    schema = f"conv_id {conv}, turn {turn}, edit string, old_role string, role string, text string, fault string, cost int, total long"
    names = ["conv_id", "turn", "edit", "old_role", "role", "text", "fault", "cost", "total"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A piece's codes come before its first row; only pieces that begin among equal rows wait for others."""
        out: list[list] = [[] for _ in names]
        held = 0
        at, conv_id, position, lane, used, total = None, None, 0, 0, 0, 0
        waiting: deque[tuple[bytes, bytes]] = deque()
        kinds: list[pa.DataType] = []

        def put(*values: object) -> None:
            for column, value in zip(out, values, strict=True):
                column.append(value)

        def insert() -> None:
            nonlocal position
            put(conv_id, None, INSERT, None, _NAMES[DUE[position] - 2], "", "", COST[INSERT], total)
            position = DUE[position]

        def full() -> pa.RecordBatch:
            nonlocal out, held
            done = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)
            out, held = [[] for _ in names], 0
            return done

        for batch in batches:
            kinds = [batch.column("conv").type, batch.column("turn").type, *[pa.string()] * 5, pa.int32(), pa.int64()]
            for g, own, turn_, role, kind, text, all_, faults, codes_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != at:
                    while position in (1, 2):
                        insert()
                    at, position, used = g, 0, 0
                if kind == 0:
                    waiting.append((faults, codes_))
                    total = all_ if all_ is not None else total
                    continue
                conv_id = own
                if used == 0:
                    lane = position
                faults_, codes_ = waiting[0]
                inserts, edit = divmod(codes_[4 * used + lane], len(EDITS))
                for _ in range(inserts):
                    insert()
                letter, fault, new = EDITS[edit], faults_[used], role
                if letter == RENAME:
                    new, position = _NAMES[DUE[position] - 2], DUE[position]
                elif letter == KEEP:
                    position = KEPT[position, ROLES.index(role[:1]) if role[:1] in ROLES[:3] else 3]
                put(own, turn_, letter, role, new, text, FAULTS[fault], COST[letter] + (TRUNCATED if FAULTS[fault] == "truncated" and letter in (KEEP, RENAME) else 0), total)
                used += 1
                if used == len(faults_):
                    waiting.popleft()
                    used = 0
                held += len(text)
                if len(out[0]) >= ROWS or held >= BYTES:
                    yield full()
        while position in (1, 2):
            insert()
        if out[0]:
            yield full()

    return both.mapInArrow(emit, schema)


def conversation_digests(edits: DataFrame) -> DataFrame:
    """One row per conversation of ``repair_conversations``' result: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Reads the edits as they come, so it must follow the operator without a shuffle between. ``gaps``: turns missing between the least and the largest; ``illegal``: adjacent
    rows before the repair whose roles' first letters aren't su, ua or au; ``audit``: the edits' letters; the digest is of the repaired ``role:text``, joined by newlines.
    """
    kind = edits.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, at, total = False, None, 0
        counts: dict[str, int] = {}
        turns: list[int] = []
        audit, last, sha, first = bytearray(), None, hashlib.sha256(), True

        def done() -> pa.RecordBatch:
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
            values = [at, gaps, *(counts.get(f, 0) for f in FAULTS[1:]), counts.get("illegal", 0), total, audit.decode(), sha.hexdigest()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [conv_kind, *[pa.int64()] * 6, pa.string(), pa.string()], strict=True)], names=names)

        ready: list[pa.RecordBatch] = []
        for batch in batches:
            conv_kind = batch.column("conv_id").type
            for conv, turn, edit, old, role, text, fault, _, cost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or conv != at:
                    if begun:
                        ready.append(done())
                    begun, at, total, counts, turns = True, conv, cost, {}, []
                    audit, last, sha, first = bytearray(), None, hashlib.sha256(), True
                audit += edit.encode()
                if edit != INSERT:
                    if fault:
                        counts[fault] = counts.get(fault, 0) + 1
                    if last is not None and last + old[:1] not in ("su", "ua", "au"):
                        counts["illegal"] = counts.get("illegal", 0) + 1
                    last = old[:1]
                    if turn is not None:
                        turns = [turns[0], turn, turns[2] + (turn != turns[1])] if turns else [turn, turn, 1]
                if edit != "D":
                    sha.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                    first = False
            if ready:
                yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                ready = []
        if begun:
            yield from [*ready, done()]

    return edits.mapInArrow(digest, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
