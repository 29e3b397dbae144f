"""Repair of conversations whose turns are missing, empty, doubled, cut off or out of order.

Each row is kept, gets another role or is deleted, and rows may be inserted, so that the roles become `(s?(ua)+)?` at least
cost. The forward Viterbi recursion runs over four grammar states (nothing yet, after system, after user, after assistant)
and carries the least (cost, audit string); the transitions of at most two inserts close each turn's layer. Letters of the
audit are those of the edits, and the least string wins ties: of two audits of one prefix with equal cost none begins
with the other, as one more insert costs more, so taking least prefixes is exact.

A layer is a 4 x 4 matrix over (least cost, least audit), and so is a run of layers. A conversation of more than 512 rows is
dealt out in parts, whose matrices are joined in order; shorter ones are solved where they are read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _turns
from ._common import map_rows, staged

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: What may stand before a user or an assistant.
MOVES = [(NOTHING, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT)]
LEGAL = {"su", "ua", "au"}

Cell = tuple[int, str] | None
Matrix = list[list[Cell]]


def _least(cells: list[Cell]) -> Cell:
    return min((c for c in cells if c is not None), default=None)


def _then(a: Matrix, b: Matrix) -> Matrix:
    joined = [[[(x[0] + y[0], x[1] + y[1]) for x, y in zip(row, column, strict=True) if x is not None and y is not None] for column in zip(*b, strict=True)] for row in a]
    return [[_least(cells) for cells in row] for row in joined]


def _matrix(cells: dict[tuple[int, int], list[Cell]]) -> Matrix:
    return [[_least(cells.get((i, j), [])) for j in range(4)] for i in range(4)]


_STAY = _matrix({(i, i): [(0, "")] for i in range(4)})
_INSERT = _matrix({(i, i): [(0, "")] for i in range(4)} | {m: [(INSERT, "I")] for m in MOVES})
CLOSING = _then(_INSERT, _INSERT)


def _layer(initial: str, fault: str) -> list[tuple[int, int, int, str]]:
    """Transitions (from, to, cost, letters) of a row with this initial of its role, inserts behind it included."""
    cells: dict[tuple[int, int], list[Cell]] = {(i, i): [(DELETE, "D")] for i in range(4)}
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        kept = {"s": [(NOTHING, SYSTEM)], "u": MOVES[:3], "a": MOVES[3:]}.get(initial, [])
        for move in MOVES:
            cells.setdefault(move, []).append((REROLE + more, "R"))
        for move in kept:
            cells.setdefault(move, []).append((KEEP + more, "K"))
    closed = _then(_matrix(cells), CLOSING)
    return [(i, j, *cell) for i, row in enumerate(closed) for j, cell in enumerate(row) if cell is not None]


LAYERS = {(i, f): _layer(i, f) for i in ("s", "u", "a", "") for f in ("", "blank", "duplicate", "truncated")}


def forward(turns: list[tuple[str, str]], state: list[Cell]) -> list[Cell]:
    """The least (cost, audit) by state behind rows (initial, fault), from that before them."""
    for initial, fault in turns:
        after: list[Cell] = [None] * 4
        for i, j, cost, letters in LAYERS[initial if initial in ("s", "u", "a") else "", fault]:
            if (was := state[i]) is not None:
                cell = was[0] + cost, was[1] + letters
                if after[j] is None or cell < after[j]:
                    after[j] = cell
        state = after
    return state


def begin() -> list[Cell]:
    return CLOSING[NOTHING]


def best(state: list[Cell]) -> Cell:
    """Of an empty conversation and one that ends with an assistant."""
    return _least([state[NOTHING], state[ASSISTANT]])


def replay(audit: str, rows: list[tuple[str, str]], state: int) -> Iterator[tuple[str, int | None, str, str]]:
    """(edit, row, role, text) of what stays or comes, in order; the audit fits the rows (role, text) from this state on."""
    at = 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        role, text, row = "", "", None
        if edit != "I":
            (role, text), row, at = rows[at], at, at + 1
        if edit != "K":
            role = ROLES[ASSISTANT if state == USER else USER]
        state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
        yield edit, row, role, text


def faults(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone, flaw: what a row shows by itself. Null roles and texts become one space; rows with a true `gone` only name their conversation."""
    rest = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    flaw = F.when(rest == "", "blank").when(~F.substring(rest, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")
    gone = F.coalesce("gone", F.lit(False)) if "gone" in turns.columns else F.lit(False)
    filled = turns.select("conv_id", "turn", *(F.when(gone, "").otherwise(F.coalesce(F.col(c), F.lit(" "))).alias(c) for c in ("role", "text")), gone.alias("gone"))
    return filled.withColumn("flaw", flaw)


def _counts(rows: list[tuple], again: set[int]) -> tuple[dict, list[tuple[str, str]]]:
    """(figures of a run of rows (turn, role, text, flaw, place), (initial, fault) of each); again: places of rows seen in earlier parts too."""
    seen, found, turns = set(), [], [r[0] for r in rows if r[0] is not None]
    for _, role, text, flaw, place in rows:
        fault = "blank" if flaw == "blank" else "duplicate" if (role, text) in seen or place in again else flaw
        seen.add((role, text))
        found.append((role[:1], fault))
    names = [f for _, f in found]
    pairs = sum(a + b not in LEGAL for (a, _), (b, _) in zip(found, found[1:], strict=False))
    facts = {k: names.count(k) for k in ("blank", "duplicate", "truncated")} | {"illegal": pairs, "distinct": len(set(turns)), "first": min(turns, default=None), "last": max(turns, default=None)}
    return facts | {"head": found[0][0] if found else None, "tail": found[-1][0] if found else None}, found


def _joined(a: dict | None, b: dict) -> dict:
    """Figures of two runs, one behind the other."""
    if a is None or a["head"] is None:
        return b
    if b["head"] is None:
        return a
    out = {k: a[k] + b[k] for k in ("blank", "duplicate", "truncated", "illegal", "distinct")}
    out["illegal"] += a["tail"] + b["head"] not in LEGAL
    if b["first"] is not None and a["last"] is not None:
        out["distinct"] -= a["last"] == b["first"]
    ends = [x for x in (a["first"], b["first"], a["last"], b["last"]) if x is not None]
    return out | {"first": min(ends, default=None), "last": max(ends, default=None), "head": a["head"], "tail": b["tail"]}


def _report(facts: dict, solved: Cell) -> tuple:
    gaps = 0 if facts["first"] is None else facts["last"] - facts["first"] + 1 - facts["distinct"]
    return gaps, *(facts[k] for k in ("blank", "duplicate", "truncated", "illegal")), *solved


REPORT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _hashed(pieces: Iterator[tuple[str, str]]) -> str:
    out, first = hashlib.sha256(), True
    for role, text in pieces:
        out.update(f"{'' if first else chr(10)}{role}:{text}".encode())
        first = False
    return out.hexdigest()


def _solved_whole(rows: Iterator[tuple]) -> Iterator[tuple]:
    """From rows (conv_id, gone, turn, role, text, flaw) to (conv_id, figures, audit, rows): conversations of a part's size at most."""
    for conv, group in groupby(rows, key=lambda r: r[0]):
        own = [(*r[2:], None) for r in group if not r[1]]
        facts, found = _counts(own, set())
        solved = best(forward(found, begin()))
        yield conv, _report(facts, solved), [(r[1], r[2]) for r in own]


def _sorted_whole(short: DataFrame) -> DataFrame:
    return short.select("conv_id", "gone", "turn", "role", "text", "flaw").repartition("conv_id").sortWithinPartitions("conv_id", "gone", *_turns.order())


# Conversations in parts. A part's group begins with notes: places of rows that earlier parts hold too, or the part's audit.

NOTED = ["conv_id", "part", "note", "place", "turn", "role", "text", "flaw", "gone"]


def _part_groups(rows: DataFrame, notes: DataFrame) -> DataFrame:
    """Rows of the parts with their notes in front; a note has its content in `note`."""
    some = rows.withColumn("note", F.lit(None).cast("string")).select(*NOTED)
    missing = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in NOTED if c not in notes.columns]
    both = some.unionByName(notes.select("*", *missing))
    return both.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", F.col("note").desc_nulls_last(), "place")


def _again(long: DataFrame) -> DataFrame:
    """conv_id, part, note (a place): rows whose role and text an earlier part holds; keys are combined before they are shuffled, texts aren't."""
    key = F.sha2(F.concat(F.char_length("role"), F.lit(":"), "role", F.lit(":"), "text"), 256)
    light = staged(long.filter("NOT gone").select("conv_id", "part", "place", key.alias("key")), "repair-keys")
    first = light.groupBy(F.col("conv_id").alias("its"), F.col("key").alias("its_key")).agg(F.min("part").alias("first"), F.max("part").alias("last")).filter("first < last")
    found = light.join(first, F.col("conv_id").eqNullSafe(F.col("its")) & (F.col("key") == F.col("its_key"))).filter("part > first")
    return found.select("conv_id", "part", F.col("place").cast("string").alias("note"))


def _part_matrices(rows: Iterator[tuple]) -> Iterator[tuple]:
    for (conv, part), group in groupby(rows, key=lambda r: r[:2]):
        held = list(group)
        again = {int(r[2]) for r in held if r[2] is not None}
        own = [(r[4], r[5], r[6], r[7], r[3]) for r in held if r[2] is None and not r[8]]
        facts, found = _counts(own, again)
        yield conv, part, json.dumps([facts, [forward(found, [(0, "") if i == j else None for j in range(4)]) for i in range(4)]])


def _in_order(rows: Iterator[tuple]) -> Iterator[tuple]:
    """From (conv_id, part, figures and matrix) in order to a row per conversation: its report, its parts with the audit and the state before."""
    for conv, group in groupby(rows, key=lambda r: r[0]):
        facts, state, parts = None, begin(), []
        trail = [None if c is None else ((), c[1]) for c in state]  # by state: the (state before, audit) of each part so far
        for _, part, told in group:
            its, matrix = json.loads(told)
            facts = _joined(facts, its)
            found = [[(state[i][0] + cell[0], state[i][1] + cell[1], i, cell[1]) for i in range(4) if state[i] is not None and (cell := matrix[i][j]) is not None] for j in range(4)]
            chosen = [min(options, default=None) for options in found]
            trail = [None if c is None else ((trail[c[2]], c[2]), c[3]) for c in chosen]
            state = [None if c is None else c[:2] for c in chosen]
            parts.append(part)
        solved = best(state)
        back, steps = trail[next(j for j in (NOTHING, ASSISTANT) if state[j] == solved)], []
        for part in reversed(parts):
            (back, before), audit = back
            steps.append(json.dumps([part, before, audit]))
        yield conv, *_report(facts, solved), back[1], steps[::-1]


def _replayed(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Parts with their audits in front to repaired rows (conv_id, part, i, edit, place, role, text)."""
    for (conv, part), group in groupby(rows, key=lambda r: r[:2]):
        held = list(group)
        _, before, audit = json.loads(held[0][2])
        own = [r for r in held if r[2] is None and not r[8]]
        for i, (edit, row, role, text) in enumerate(replay(audit, [(r[5], r[6]) for r in own], before)):
            yield conv, part, i, edit, None if row is None else own[row][3], role, text


def _long_solved(long: DataFrame) -> DataFrame:
    """conv_id, REPORT, opening (inserts before the first row), steps; staged."""
    conv = f"conv_id {long.schema['conv_id'].dataType.simpleString()}"
    matrices = map_rows(_part_groups(long, _again(long)), _part_matrices, f"{conv}, part bigint, told string")
    told = matrices.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return staged(map_rows(told, _in_order, f"{conv}, {REPORT}, opening string, steps array<string>"), "repair-solved")


def _long_rows(long: DataFrame, solved: DataFrame) -> DataFrame:
    """Repaired rows of the long conversations: conv_id, part, i, edit, place, role, text; what is inserted before the first row is in part -1."""
    conv = f"conv_id {long.schema['conv_id'].dataType.simpleString()}"
    notes = solved.select("conv_id", F.explode("steps").alias("note")).withColumn("part", F.get_json_object("note", "$[0]").cast("long"))
    rows = map_rows(_part_groups(long, notes), _replayed, f"{conv}, part bigint, i bigint, edit string, place bigint, role string, text string")
    inserted = solved.select("conv_id", F.lit(-1).cast("long").alias("part"), F.posexplode(F.split(F.regexp_replace("opening", "I(?=I)", "I,"), ",")).alias("i", "edit")).filter("edit <> ''")
    first = inserted.select("conv_id", "part", F.col("i").cast("long"), "edit", F.lit(None).cast("long").alias("place"), F.when(F.col("i") == 0, "user").otherwise("assistant").alias("role"), F.lit("").alias("text"))
    return rows.unionByName(first)


def repaired(turns: DataFrame, part_rows: int = _turns.PART_ROWS) -> DataFrame:
    """The rows of the repaired conversations: conv_id, part, i (their order), edit (K, R or I), role, text.

    turns has conv_id, turn, role, text and, for rows that only name their conversation, gone. Rows go by turn, nulls first, then by
    role and text. Null roles and texts become one space; rows without conv_id are one conversation; repeated rows are
    duplicates; a conversation of which nothing stays has no rows. Texts count whole; other columns are ignored.
    """
    conv = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}"
    short, long = _turns.dealt(faults(turns), part_rows, "repair")

    def of(rows: Iterator[tuple]) -> Iterator[tuple]:
        for its, report, own in _solved_whole(rows):
            for i, (edit, _, role, text) in enumerate(replay(report[-1], own, NOTHING)):
                yield its, 0, i, edit, role, text

    out = map_rows(_sorted_whole(short), of, f"{conv}, part bigint, i bigint, edit string, role string, text string")
    return out if long is None else out.unionByName(_long_rows(long, _long_solved(long)).drop("place"))


def reports(turns: DataFrame, part_rows: int = _turns.PART_ROWS) -> DataFrame:
    """A row per conversation: conv_id, REPORT, repaired_sha256 (of `role:text`, newline-joined); rows as for repaired().

    A conversation without rows, but named by one that is gone, has zeros, an empty audit and the hash of nothing; an empty table
    gives no rows. Conversations in parts are hashed in order, row by row.
    """
    schema = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, {REPORT}, repaired_sha256 string"
    short, long = _turns.dealt(faults(turns), part_rows, "repair")

    def of(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, report, own in _solved_whole(rows):
            yield conv, *report, _hashed((role, text) for _, _, role, text in replay(report[-1], own, NOTHING))

    out = map_rows(_sorted_whole(short), of, schema)
    if long is None:
        return out
    solved = _long_solved(long)

    def hashed(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, group in groupby(rows, key=lambda r: r[0]):
            yield conv, _hashed(r[3:5] for r in group if r[3] is not None)

    # every conversation has a row without a role, so one of which nothing stays is hashed too
    named = solved.select("conv_id", F.lit(-2).cast("long").alias("part"), F.lit(0).cast("long").alias("i"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    pieces = _long_rows(long, solved).select("conv_id", "part", "i", "role", "text").unionByName(named)
    hashes = map_rows(pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "i"), hashed, f"its {turns.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")
    both = solved.drop("opening", "steps").join(hashes, F.col("conv_id").eqNullSafe(F.col("its"))).drop("its")
    return out.unionByName(both)


def damaged(convs: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: one row in five is harmed, as crc32 of `conv_id:turn` modulo 20 says (0 gone, 1 emptied, 2 without `[.!?]`, 3 doubled, 4 made a user's). Nulls count as one space."""
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    harm = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    rows = convs.select("conv_id", "turn", role.alias("role"), text.alias("text"), harm.alias("harm"))
    times = F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    harmed = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    named = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", named.alias("role"), harmed.alias("text"), (F.col("harm") == 0).alias("gone"), times.alias("time")).drop("time")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


#: The recursion over rows carries a state's least (cost, audit) as a struct; inserts are written out, at most two behind each row.
ORACLE = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS tab
  FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
), source AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS told FROM conversations
), harm AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(told, ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS harm
  FROM source, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role, CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM harm, range(2) r(i) WHERE harm <> 0 AND (i = 0 OR harm = 3)
), placed AS (
  SELECT *, row_number() OVER w AS k, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS ink FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) AS again FROM placed
), flawed AS (
  SELECT *, CASE WHEN ink = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN right(ink, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, left(role, 1) AS initial,
    left(lag(role) OVER (PARTITION BY conv_id ORDER BY k), 1) AS past FROM seen
), moves(i, j) AS (VALUES ('', 'u'), ('s', 'u'), ('a', 'u'), ('u', 'a')), states(i) AS (VALUES (''), ('s'), ('u'), ('a')),
inserts AS (
  SELECT i, i AS j, 0 AS cost, '' AS letters FROM states UNION ALL SELECT i, j, 5, 'I' FROM moves UNION ALL SELECT a.i, b.j, 10, 'II' FROM moves a JOIN moves b ON a.j = b.i
), edits AS (
  SELECT i, i AS j, 2 AS cost, 'D' AS letter, NULL AS needs FROM states UNION ALL SELECT i, j, 1, 'R', NULL FROM moves UNION ALL SELECT i, j, 0, 'K', j FROM moves UNION ALL SELECT '', 's', 0, 'K', 's'
), steps AS (
  SELECT e.i, n.j, e.cost + n.cost AS cost, letter, letter || letters AS letters, needs FROM edits e JOIN inserts n ON n.i = e.j
), best AS (
  SELECT conv_id, 0::BIGINT AS k, j AS state, min({'cost': cost, 'audit': letters}) AS p FROM (SELECT DISTINCT conv_id FROM damaged), inserts WHERE i = '' GROUP BY conv_id, j
  UNION ALL
  SELECT b.conv_id, f.k, s.j, min({'cost': p.cost + s.cost + CASE WHEN fault = 'truncated' AND letter <> 'D' THEN 5 ELSE 0 END, 'audit': p.audit || s.letters})
  FROM best b JOIN flawed f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.k = b.k + 1 JOIN steps s ON s.i = b.state AND (letter = 'D' OR fault NOT IN ('blank', 'duplicate')) AND (needs IS NULL OR needs = initial)
  GROUP BY b.conv_id, f.k, s.j
), facts AS (
  SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (past IS NOT NULL AND past || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM flawed GROUP BY conv_id
), solved AS (
  SELECT f.conv_id, min(p) AS p FROM best b JOIN facts f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND b.k = f.rows WHERE state IN ('', 'a') GROUP BY f.conv_id
), letters AS (
  SELECT conv_id, i, substr(p.audit, CAST(i AS INT), 1) AS letter, sum(CASE WHEN substr(p.audit, CAST(i AS INT), 1) = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY i) AS k FROM solved, range(1, 4000) r(i) WHERE i <= length(p.audit)
), stay AS (
  SELECT l.conv_id, l.i, l.letter, CASE WHEN l.letter = 'I' THEN '' ELSE text END AS text, role, row_number() OVER (PARTITION BY l.conv_id ORDER BY l.i) AS n
  FROM letters l LEFT JOIN flawed f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.k = l.k AND l.letter <> 'I' WHERE l.letter <> 'D'
), named AS (
  SELECT *, first_value(CASE WHEN letter = 'K' AND role LIKE 's%' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS begun FROM stay
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (n - begun) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i) AS told FROM named GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(p.cost, 0) AS BIGINT) AS cost, coalesce(p.audit, '') AS audit,
  sha256(coalesce(told, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
"""
