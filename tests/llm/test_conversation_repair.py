import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from spindrift.llm import conversation_repair as R

TURNS = "conv_id long, turn long, role string, text string"
INK, STOP = re.compile(r"[^\x20\x09-\x0D]"), re.compile(r"[.!?]")
FINISHED = re.compile(r"(s?(ua)+)?")


def harmed(data):
    """Rows (conv_id, turn, role, text) after damage, by conversation, in order."""
    out = {r[0]: [] for r in data}
    for conv, turn, role, text in data:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 1:
            text = ""
        if k == 2:
            text = STOP.sub("", text)
        if k == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return {c: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, rows in out.items()}


def first_faults(rows):
    for i, (_, role, text) in enumerate(rows):
        ink = INK.findall(text)
        yield "blank" if not ink else "duplicate" if any((role, text) == r[1:] for r in rows[:i]) else "" if STOP.match(ink[-1]) else "truncated"


def cheapest(rows, faults):
    """Best first over (rows done, roles so far told by their last ones): least cost, then least audit; the repaired rows come along."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    todo, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, last, out = heapq.heappop(todo)
        if (at, last) in done:
            continue
        done.add((at, last))
        if at == len(rows) and last in ("", "a"):
            return cost, audit, out
        for name in ("user", "assistant"):
            if name[0] in follows[last]:
                heapq.heappush(todo, (cost + 5, audit + "I", at, name[0], (*out, (name, ""))))
        if at < len(rows):
            _, role, text = rows[at]
            heapq.heappush(todo, (cost + 2, audit + "D", at + 1, last, out))
            if faults[at] in ("", "truncated"):
                more = 5 * (faults[at] == "truncated")
                if role[:1] and role[:1] in follows[last]:
                    heapq.heappush(todo, (cost + more, audit + "K", at + 1, role[0], (*out, (role, text))))
                for name in ("user", "assistant"):
                    if name[0] in follows[last]:
                        heapq.heappush(todo, (cost + more + 1, audit + "R", at + 1, name[0], (*out, (name, text))))


def solved(rows):
    faults = list(first_faults(rows))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, out = cheapest(rows, faults)
    assert FINISHED.fullmatch("".join(r[0] for r, _ in out))
    told = "\n".join(f"{r}:{t}" for r, t in out)
    return gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(told.encode()).hexdigest()


def brute(data):
    return [(c, *solved(rows)) for c, rows in harmed(data).items()]


def same(got, want):
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)


def invented(seed, convs, most):
    draw = random.Random(seed)
    for conv in range(convs):
        turn = 0
        for _ in range(draw.randint(1, most)):
            turn += draw.choice([0, 1, 1, 1, 2, 9])
            role = draw.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "s", "agent"])
            text = draw.choice([None, "", " \n\t", "One.", "one", "Two! ", "three?\n", "x", "a b c", f"{draw.random()}.", f"{draw.random()}", "漢。", "end.\x85"])
            yield conv, draw.choice([turn, turn, turn, None]), role, text


@pytest.mark.parametrize(("seed", "convs", "most", "part_rows"), [(1, 150, 9, 512), (2, 40, 30, 7), (3, 12, 60, 5), (4, 60, 8, 1), (5, 30, 6, 3)])
def test_against_best_first_search(spark, seed, convs, most, part_rows):
    data = list(invented(seed, convs, most)) + [(None, 1, "user", "one."), (None, 0, "assistant", "two"), (None, 0, "assistant", "two")]
    rows = spark.createDataFrame(data, TURNS).selectExpr("*", "'x' AS part", "'y' AS place", "'z' AS note", "'w' AS flaw", "1 AS harm")
    same(R.reports(R.damaged(rows), part_rows).collect(), brute(data))


@pytest.mark.parametrize("part_rows", [512, 4])
def test_repaired_rows(spark, part_rows):
    data = list(invented(6, 30, 20))
    got = R.repaired(R.damaged(spark.createDataFrame(data, TURNS)), part_rows).collect()
    for conv, rows in harmed(data).items():
        own = sorted((r for r in got if r.conv_id == conv), key=lambda r: (r.part, r.i))
        cost, audit, out = cheapest(rows, list(first_faults(rows)))
        assert [(r.role, r.text) for r in own] == list(out) and "".join(r.edit for r in own) == audit.replace("D", "")


def test_every_short_run_of_edits_was_weighed():
    """The recursion against all edits of small conversations, not only against another search."""
    inserts = ["", "u", "a", "ua", "au", "uau"]
    for rows in itertools.product([("s", ""), ("u", ""), ("a", "truncated"), ("t", ""), ("a", "blank")], repeat=2):
        found = []
        for gaps in itertools.product(inserts, repeat=3):
            for edits in itertools.product("KRrD", repeat=2):
                if any(e != "D" and f in ("blank", "duplicate") for e, (_, f) in zip(edits, rows, strict=True)):
                    continue
                roles, audit, cost = gaps[0], "I" * len(gaps[0]), 5 * len(gaps[0])
                for e, (initial, fault), gap in zip(edits, rows, gaps[1:], strict=True):
                    roles += {"K": initial, "R": "u", "r": "a", "D": ""}[e] + gap
                    audit += e.upper() + "I" * len(gap)
                    cost += {"K": 0, "R": 1, "r": 1, "D": 2}[e] + 5 * len(gap) + 5 * (fault == "truncated" and e != "D")
                if FINISHED.fullmatch(roles):
                    found.append((cost, audit))
        assert R.best(R.forward(list(rows), R.begin())) == min(found)


def test_one_conversation_may_fill_the_table(spark):
    data = [(7, i // 2, ("user", "assistant")[i % 3 == 0], f"text {i % 40}{'.' * (i % 5 > 0)}") for i in range(700)] + [(8, 0, "user", "hm")]
    same(R.reports(R.damaged(spark.createDataFrame(data, TURNS).repartition(6)), 16).collect(), brute(data))


def test_nothing_stays_and_empty_tables(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    data = [(gone, 0, "user", "all is dropped.")]
    got = R.reports(R.damaged(spark.createDataFrame(data, TURNS))).collect()
    assert list(map(tuple, got)) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    blank = spark.createDataFrame([(1, i, "user", " ") for i in range(9)], TURNS)
    for part_rows in (512, 2):
        assert [tuple(r) for r in R.reports(blank, part_rows).collect()] == [(1, 0, 9, 0, 0, 8, 18, "D" * 9, hashlib.sha256(b"").hexdigest())]
    assert R.reports(R.damaged(spark.createDataFrame([], TURNS))).count() == 0 and R.repaired(spark.createDataFrame([], TURNS)).count() == 0


def test_the_query(spark, sf_dir):
    data = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(R.op13_conversation_repair(spark, sf_dir).collect(), brute(data))
