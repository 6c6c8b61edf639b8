"""Repairs against a search of all edits, and against plain Python over damaged tables."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversations, registry
from tidemark.llm.conversations import Chart, Grammar

ROLE = {"u": "user", "a": "assistant"}


def sha(turns):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()


def cheapest(rows):
    """The cheapest edits of rows (role, text, must be deleted, truncated), over states of the pattern."""
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            return cost, audit, sha(out)
        if (i, state) in done:
            continue
        done.add((i, state))
        for t, q in {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[state].items():
            if t in ROLE:
                heapq.heappush(heap, (cost + 5, audit + "I", i, q, (*out, (ROLE[t], ""))))
            if i < len(rows) and not rows[i][2]:
                role, text, _, late = rows[i]
                if role[:1] == t:
                    heapq.heappush(heap, (cost + 5 * late, audit + "K", i + 1, q, (*out, (role, text))))
                elif t in ROLE:
                    heapq.heappush(heap, (cost + 1 + 5 * late, audit + "R", i + 1, q, (*out, (ROLE[t], text))))
        if i < len(rows):
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, out))


def all_edits(rows, most=2):
    """Every choice of edits with at most ``most`` insertions in each place: no dynamic programming."""
    found = []

    def go(i, cost, audit, out):
        for k in range(most + 1):
            for seq in ([()] if not k else [("u",), ("a",)] if k == 1 else [("u", "a"), ("a", "u")]):
                o, c, a = out + [(ROLE[s], "") for s in seq], cost + 5 * k, audit + "I" * k
                if i == len(rows):
                    if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in o)):
                        found.append((c, a, sha(o)))
                    continue
                role, text, must, late = rows[i]
                go(i + 1, c + 2, a + "D", o)
                if not must:
                    if role[:1] in ("s", "u", "a"):
                        go(i + 1, c + 5 * late, a + "K", [*o, (role, text)])
                    for r in ROLE.values():
                        go(i + 1, c + 1 + 5 * late, a + "R", [*o, (r, text)])

    go(0, 0, "", [])
    return min(found)


def random_rows(rng, most):
    return [(rng.choice(["user", "assistant", "system", "tool", " ", ""]), rng.choice(["x.", "y", ""]), rng.random() < 0.15, rng.random() < 0.15) for _ in range(rng.randint(0, most))]


def parsed(rows, shorten=False):
    chart = Chart(Grammar())
    for r in rows:
        chart.feed(*r)
        if shorten:
            chart._shorten()
    cost, audit, initials, digest = chart.finish()
    assert re.fullmatch("(s?(ua)+)?", initials)
    return cost, audit, digest


def test_chart_finds_the_cheapest_edits():
    rng = random.Random(3)
    for _ in range(2000):
        rows = random_rows(rng, 10)
        assert parsed(rows) == cheapest(rows)


def test_chart_equals_trying_all_edits():
    rng = random.Random(4)
    for _ in range(60):
        rows = random_rows(rng, 3)
        assert parsed(rows) == all_edits(rows)


def test_long_conversations_are_shortened_on_the_way():
    rng = random.Random(5)
    rows = [r for _ in range(30) for r in random_rows(rng, 10)]
    assert parsed(rows, shorten=True) == parsed(rows) == cheapest(rows)
    rows = [(("user", "assistant")[i % 2], "a.", False, False) for i in range(9001)]
    cost, audit, _ = parsed(rows)
    assert (cost, len(audit), audit.count("D")) == (2, 9001, 1)


def test_other_grammars():
    # any number of questions, each answered by a tool and then by the assistant
    g = Grammar(productions=(("S", ()), ("S", ("S", "u", "t", "a"))), roles=(("u", "user"), ("t", "tool"), ("a", "assistant")))
    chart = Chart(g)
    for role in ("user", "assistant", "user", "tool", "assistant"):
        chart.feed(role, "x.")
    assert chart.finish()[:3] == (4, "DDKKK", "uta")
    with pytest.raises(ValueError):
        Grammar(productions=(("S", ("u", "S")), ("S", ())))
    none = Chart(Grammar(productions=(("S", ("z",)),)))
    none.feed("user", "x.")
    assert none.finish() is None


def plain(rows):
    """The query in plain Python, for (conv_id, turn, role, text)."""
    convs = {}
    for conv, turn, role, text in rows:
        out = convs.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    result = {}
    for conv, got in convs.items():
        got.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults, edits = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, role, text in got:
            last = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            edits.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [r[0] for r in got if r[0] is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(got, got[1:], strict=False))
        result[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *faults.values(), illegal, *cheapest(edits))
    return result


def summaries(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def odd_rows():
    rng = random.Random(9)
    text = lambda: rng.choice([None, "", " \n", "Yes.", "No", "What?\t", "é!", "Yes.", "a "])
    rows = [(rng.choice([None, *range(12)]), rng.choice([None, *range(9)]), rng.choice([None, "", "user", "assistant", "system", "User", "tool"]), text()) for _ in range(300)]
    rows += [(50, None, "user", "x."), (50, None, None, None), (51, -4, "user", "x" * 300_000), (51, 9_000_000_000, "assistant", "y." * 100_000)]
    return rows + rows[:40]


def test_odd_tables(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).withColumns({"fault": F.lit("x"), "copy": F.lit("y"), "gone": F.lit("z"), "_same": F.lit(1)})
    assert summaries(conversations.audits(conversations.damaged(df))) == plain(rows)
    assert conversations.audits(conversations.damaged(df.limit(0))).collect() == []


def test_query_equals_plain_version(spark, sf_dir):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in registry.table(spark, sf_dir, "conversations").collect()]
    assert summaries(registry.QUERIES["op12_conversation_repair"](spark, sf_dir)) == plain(rows)


def test_repaired_turns_have_the_digest_of_the_audit(spark, sf_dir):
    df = conversations.damaged(registry.table(spark, sf_dir, "conversations"))
    turns = {}
    for r in conversations.repaired(df).collect():
        turns.setdefault(r.conv_id, []).append(r)
    for conv, found in ((r.conv_id, r) for r in conversations.audits(df).collect()):
        rows = sorted(turns.get(conv, []), key=lambda r: r.position)
        assert [r.position for r in rows] == list(range(len(rows)))
        assert "".join(r.edit for r in rows) == found.audit.replace("D", "")
        assert sha((r.role, r.text) for r in rows) == found.repaired_sha256


def test_texts_move_once_and_conversations_are_streamed(spark, sf_dir):
    plan = registry.QUERIES["op12_conversation_repair"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "FlatMapGroups" not in plan and "collect_list" not in plan
