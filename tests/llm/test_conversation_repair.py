"""Conversation repair against all edit sequences, and against a plain search conversation by conversation."""

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import numpy as np
import pytest

from strata.llm import conversation_repair, queries
from strata.llm.conversation_repair import conversation_digests, damage_conversations, repair_conversations
from strata.llm.repair_automaton import LAST, Automaton, before

SPACE = "[\x20\x09-\x0d]"
COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (conv, turn, "user" if kind == 4 else role, text)
        out += [] if kind == 0 else [row] * (2 if kind == 3 else 1)
    return out


def plain(rows):
    """One conversation's digest columns, by the cheapest way from every row and position."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = re.sub(f"{SPACE}+$", "", text)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))

    @cache
    def best(k, at, inserted):
        due, name = (3, "assistant") if at == 2 else (2, "user")
        ways = [] if inserted == 3 else [(5 + c, "I" + a, [f"{name}:", *t]) for c, a, t in [best(k, due, inserted + 1)]]
        if k == len(rows):
            return min([*ways, *([(0, "", [])] if at in (0, 3) else [])], default=(10**6, "", []))
        role, text = rows[k][2:]
        c, a, t = best(k + 1, at, 0)
        ways.append((2 + c, "D" + a, t))
        if faults[k] not in ("blank", "duplicate"):
            late = 5 * (faults[k] == "truncated")
            c, a, t = best(k + 1, due, 0)
            ways.append((1 + late + c, "R" + a, [f"{name}:{text}", *t]))
            to = 1 if role[:1] == "s" and at == 0 else due if role[:1] == name[0] else None
            if to is not None:
                c, a, t = best(k + 1, to, 0)
                ways.append((late + c, "K" + a, [f"{role}:{text}", *t]))
        return min(ways)

    cost, audit, texts = (0, "", []) if not rows else (best(0, 0, 0)[0], best(0, 0, 0)[1], best(0, 0, 0)[2])
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(texts).encode()).hexdigest())


def every_way(symbols):
    """Least (cost, letters) over all edits with two inserts at most at each place."""
    best = (10**6, "")
    for inserts in itertools.product(range(3), repeat=len(symbols) + 1):
        for edits in itertools.product("DKR", repeat=len(symbols)):
            for start in itertools.product("ua", repeat=sum(inserts) + edits.count("R")):
                names, roles, cost, letters = iter(start), "", 5 * sum(inserts), ""
                for k, (edit, symbol) in enumerate(zip(edits, symbols, strict=True)):
                    role, fault = symbol % 4, symbol // 4
                    roles += "".join(next(names) for _ in range(inserts[k]))
                    letters += "I" * inserts[k] + edit
                    if edit != "D" and fault in (1, 2):
                        cost = 10**6
                    cost += {"D": 2, "K": 0, "R": 1}[edit] + 5 * (edit != "D" and fault == 3)
                    roles += {"D": "", "K": "suax"[role], "R": ""}[edit] or (next(names) if edit == "R" else "")
                roles += "".join(next(names) for _ in range(inserts[-1]))
                letters += "I" * inserts[-1]
                if re.fullmatch("(s?(ua)+)?", roles):
                    best = min(best, (cost, letters))
    return best


def found(symbols, cuts=()):
    """(cost, letters) by the automaton, the rows cut into pieces."""
    made, pieces = Automaton(), [np.array(p, np.int64) for p in np.split(np.array(symbols, np.int64), list(cuts))]
    after = [np.array(LAST)]
    for p in reversed(pieces):
        after.insert(0, before(made.matrices(p, np.array([0, len(p)]))[0], after[0]))
    at, letters = 0, ""
    for p, v in zip(pieces, after[1:], strict=True):
        kept, offsets = np.zeros(len(p), np.int64), np.array([0, len(p)])
        made.scan(p, offsets, np.array([made.state(v.tolist())[0]]), kept)
        for k, code in enumerate(made.trace(p, offsets, kept)[:, at].tolist()):
            inserts, edit = divmod(code, 3)
            letters += "I" * inserts + "DKR"[edit]
            for _ in range(inserts):
                at = 3 if at == 2 else 2
            at = at if edit == 0 else (3 if at == 2 else 2) if edit == 2 else 1 if p[k] % 4 == 0 else 2 if p[k] % 4 == 1 else 3
    return int(after[0][0]), letters + ("I" if at == 2 else "II" if at == 1 else "")


def test_edits_are_the_least_of_all():
    rng = random.Random(4)
    for n in (0, 1, 2):
        for symbols in itertools.product(range(16), repeat=n):
            if n < 2 or rng.random() < 0.25:
                assert found(symbols) == every_way(symbols)


def test_pieces_change_nothing_and_states_stay_few():
    rng = random.Random(5)
    for _ in range(300):
        symbols = [rng.choice([0, 1, 1, 2, 2, 3, 5, 9, 12, 13, 14, 15]) for _ in range(rng.randrange(1, 30))]
        cuts = sorted(rng.sample(range(len(symbols) + 1), min(3, len(symbols))))
        assert found(symbols, cuts) == found(symbols)
    made = Automaton()
    made.matrices(np.array([rng.randrange(16) for _ in range(50_000)]), np.array([0, 50_000]))
    assert len(made.vectors) < 400


def rows_for_tests():
    rng = random.Random(6)
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rng.choice([0, 1, 3, 9, 40])):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None])
            text = rng.choice(["One.", "Two!", "cut", "", None, " \t", "é ü?", "long " * 50 + ".", "a\nb. \n"]) if turn % 3 else f"Text {turn}."
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), role, text))
    return [*rows, (7, 1, "user", "same."), (7, 1, "user", "same."), (99, -5, "user", "x" * 300_000)]


@pytest.mark.parametrize("piece", [3, 4096])
def test_equals_a_plain_search(spark, monkeypatch, piece):
    monkeypatch.setattr(conversation_repair, "PIECE", piece)
    rows = rows_for_tests()
    given = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, g string, n int, h int").repartition(5)
    after = damaged(rows)
    want = {c: plain([r for r in after if r[0] == c]) for c in {r[0] for r in after}}
    edits = repair_conversations(damage_conversations(given))
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in conversation_digests(edits).collect()}
    assert got == want
    for row in edits.groupBy("conv_id").agg({"cost": "sum", "total": "max"}).collect():
        assert row["sum(cost)"] == row["max(total)"] == want[row.conv_id][5]
    assert edits.where("edit <> 'I'").count() == len(after)


def test_other_columns_and_no_rows(spark):
    given = spark.createDataFrame([("a", 1, "user", "Hi."), ("a", 2, "bot", "Yo."), (None, 1, "user", "Hi.")], "c string, t int, r string, x string")
    got = repair_conversations(given, "c", "t", "r", "x")
    assert sorted((r.conv_id or "", r.edit, r.role, r.text) for r in got.collect()) == [("", "D", "user", "Hi."), ("a", "K", "user", "Hi."), ("a", "R", "assistant", "Yo.")]
    assert repair_conversations(given.where("false"), "c", "t", "r", "x").count() == 0


def test_query_keeps_conversations_without_rows(spark, sf_dir):
    every = queries.table(spark, sf_dir, "conversations")
    assert queries.op11_conversation_repair(spark, sf_dir).count() == every.select("conv_id").distinct().count()
