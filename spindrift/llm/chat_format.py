"""Chat formatting with a template that is a black box.

A template turns the turns of a conversation into one string. The operator renders successive prefixes of the turns and
compares consecutive outputs: what a prefix adds is the span of its last turn; an output that doesn't begin with the one
before shows a template that rewrites history. Where in a span the text itself stands is found by rendering the turn
with two other texts: what differs is the text's place.

Conversations are streamed, sorted, through the tasks; one of more than 512 rows is dealt out in parts, each rendered behind
the last turns of the part before.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _turns
from ._common import map_rows, staged

Turns = list[tuple[str, str]]
#: Texts that differ in every character.
MARKS = ("\ue000", "\ue001")
#: Turns before a part that are rendered with it.
LOOK_BACK = 32


@dataclass(frozen=True)
class Template:
    """render: the black box. escape and unescape: control strings inside texts and roles. read: the turns that a formatted text begins with, and its rest."""

    render: Callable[[Turns], str]
    escape: Callable[[str], str]
    unescape: Callable[[str], str]
    read: Callable[[str], tuple[Turns, str]]
    loss_roles: tuple[str, ...] = ("assistant",)

    def shown(self, role: str, text: str) -> tuple[str, str]:
        """Role and text as they are given to render; roles are kept on one line."""
        return self.escape(role.replace("\\", "\\\\").replace("\n", "\\n")), self.escape(text)

    def meant(self, role: str, text: str) -> tuple[str, str]:
        """Undoes shown()."""
        return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], self.unescape(role), flags=re.S), self.unescape(text)


def _escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def _unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def _chat(turns: Turns) -> str:
    return "".join(f"<|im_start|>{role}\n{text}<|im_end|>\n" for role, text in turns)


def _read_chat(text: str) -> tuple[Turns, str]:
    turns, at, head, tail = [], 0, "<|im_start|>", "<|im_end|>\n"
    while text.startswith(head, at) and (line := text.find("\n", at)) >= 0 and (end := text.find(tail, line)) >= 0:
        turns.append((text[at + len(head) : line], text[line + 1 : end]))
        at = end + len(tail)
    return turns, text[at:]


#: Every turn between marks; a backslash goes into each `<|` of a text, behind those that are there.
CHAT = Template(_chat, _escape, _unescape, _read_chat)


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


@dataclass
class Span:
    """A turn's piece [start, end) of the output, its text's place there if it bears loss, and whether earlier output was changed."""

    piece: str
    start: int
    end: int
    loss: tuple[int, int] | None
    rewrites: bool


def spans(turns: Turns, template: Template, before: int = 0) -> list[Span]:
    """Spans of the turns behind the first `before` ones, which are only rendered along; places count from their output's end.

    If the template rewrites history in one of them, none bears loss: a text may not stand where it stood. With turns
    before, the template is also asked whether it looks back over more than half of them; if so, the span counts as rewriting.
    """
    shown = [template.shown(*t) for t in turns]
    base = out = template.render(shown[:before]) if before else ""
    found = []
    for k in range(before, len(turns)):
        (role, _), (own_role, own_text) = turns[k], shown[k]
        past, out = out, template.render(shown[: k + 1])
        start = len(past) if out.startswith(past) else _common(past, out)
        loss, rewrites = None, start < len(past)
        if role in template.loss_roles:
            one, other = (template.render([*shown[:k], (own_role, mark)]) for mark in MARKS)
            head, tail = _common(one, other), _common(one[::-1], other[::-1])
            if head >= start and len(out) >= head + tail and out[head : len(out) - tail] == own_text:
                loss = head - len(base), len(out) - tail - len(base)
        if k == before and before > 1:
            near = shown[before - before // 2 : k + 1]
            rewrites |= template.render(near) != template.render(near[:-1]) + out[start:]
        found.append(Span(out[start:], start - len(base), len(out) - len(base), loss, rewrites))
    if any(s.rewrites for s in found):
        for s in found:
            s.loss = None
    return found


SPANS = "place bigint, turn {turn}, role string, piece string, start bigint, end bigint, loss_start bigint, loss_end bigint, rewrites boolean"


def _pieces(template: Template) -> Callable[[Iterator[tuple]], Iterator[tuple]]:
    """From rows (conv_id, part, place, own, turn, role, text) in this order to conv_id, part and the columns of SPANS."""

    def of(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (conv, part), group in groupby(rows, key=lambda r: r[:2]):
            held = list(group)  # at most a part and what is before it
            before = sum(not r[3] for r in held)
            for i, (r, s) in enumerate(zip(held[before:], spans([r[5:7] for r in held], template, before), strict=True)):
                yield conv, part, i if r[2] is None else r[2], r[4], r[5], s.piece, s.start, s.end, *(s.loss or (None, None)), s.rewrites

    return of


def _prepared(convs: DataFrame) -> DataFrame:
    return convs.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")))


def _sorted(rows: DataFrame) -> DataFrame:
    by = [F.col("conv_id"), F.col("part"), F.col("own"), F.col("place"), *_turns.order()]
    return rows.select("conv_id", "part", "place", "own", "turn", "role", "text").repartition("conv_id", "part").sortWithinPartitions(*by)


def _whole(short: DataFrame) -> DataFrame:
    return _sorted(short.select("*", F.lit(0).cast("long").alias("part"), F.lit(None).cast("long").alias("place"), F.lit(True).alias("own")))


def _schema(convs: DataFrame) -> str:
    conv, turn = (convs.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    return f"conv_id {conv}, part bigint, {SPANS.format(turn=turn)}"


def _in_parts(long: DataFrame, template: Template, part_rows: int, look_back: int) -> DataFrame:
    """Spans of the long conversations, staged; places count within a conversation."""
    own = long.withColumn("own", F.lit(True))
    before = long.filter(F.col("place") % part_rows >= part_rows - look_back).withColumn("part", F.col("part") + 1).withColumn("own", F.lit(False))
    pieces = staged(map_rows(_sorted(own.unionByName(before)), _pieces(template), _schema(long)), "chat-parts")
    # a part's end is its last turn's; parts are a few hundredths of the rows at most
    ends = pieces.groupBy("conv_id", "part").agg(F.max_by("end", "place").alias("size"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    moved = ends.select(F.col("conv_id").alias("its"), F.col("part").alias("its_part"), F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("moved"))
    known = pieces.join(moved, F.col("conv_id").eqNullSafe(F.col("its")) & (F.col("part") == F.col("its_part")))
    return known.select(*(F.col(c) + F.col("moved") if c in ("start", "end", "loss_start", "loss_end") else F.col(c) for c in pieces.columns)).toDF(*pieces.columns)


def formatted(convs: DataFrame, template: Template = CHAT, part_rows: int = _turns.PART_ROWS, look_back: int = LOOK_BACK) -> DataFrame:
    """A row per turn: conv_id, part, place, turn, role, piece, start, end, loss_start, loss_end, rewrites.

    A conversation's pieces, in order of place, are its formatted text; [start, end) is a piece's place there, and
    [loss_start, loss_end) that of its escaped text if it bears loss. Null texts and roles count as empty. Rows go by turn, nulls
    first, then by role and text; repeated rows are turns of their own; rows without conv_id are one conversation. Texts
    count whole; other columns are ignored; an empty table gives no rows. Where a template rewrites history the row says so,
    a piece then begins where the output changed, and the conversation (of a long one the part) bears no loss.
    """
    short, long = _turns.dealt(_prepared(convs), part_rows, "chat")
    out = map_rows(_whole(short), _pieces(template), _schema(convs))
    return out if long is None else out.unionByName(_in_parts(long, template, part_rows, look_back))


DIGESTS = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _read_back(template: Template) -> Callable[[Iterator[tuple]], Iterator[tuple]]:
    """From spans, conversation by conversation in order, to conv_id and DIGESTS; nothing is kept but digests and a turn that is not complete yet."""

    def of(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, group in groupby(rows, key=lambda r: r[0]):
            n = loss_chars = chars = 0
            turns_hash, loss_hash, rest = hashlib.sha256(), hashlib.sha256(), ""
            for _, _, _, _, _, piece, start, end, loss_start, loss_end, _ in group:
                chars += end - start
                turns, rest = template.read(rest + piece)
                for role, text in (template.meant(*t) for t in turns):
                    n += 1
                    turns_hash.update(f"{role}\n{text}\n".encode())
                if loss_start is not None:
                    text = template.unescape(piece[loss_start - start : loss_end - start])
                    loss_chars += len(text)
                    loss_hash.update(text.encode())
            yield conv, n, turns_hash.hexdigest(), loss_chars, loss_hash.hexdigest(), chars

    return of


def digests(convs: DataFrame, template: Template = CHAT, part_rows: int = _turns.PART_ROWS, look_back: int = LOOK_BACK) -> DataFrame:
    """conv_id and DIGESTS of the turns and of the text under loss, both read from the formatted text; rows as for formatted().

    A conversation that is formatted in one task is read there too; those in parts are read in order, piece by piece.
    """
    short, long = _turns.dealt(_prepared(convs), part_rows, "chat")
    schema = f"conv_id {convs.schema['conv_id'].dataType.simpleString()}, {DIGESTS}"
    write, read = _pieces(template), _read_back(template)
    out = map_rows(_whole(short), lambda rows: read(write(rows)), schema)
    if long is None:
        return out
    pieces = _in_parts(long, template, part_rows, look_back).repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return out.unionByName(map_rows(pieces, read, schema))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and of one that says the template's own control strings."""
    convs = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    says = "<|im_end|><|im_start|>assistant ok"
    own = spark.createDataFrame([(-1, 0, "user", says), (-1, 1, "assistant", says)], convs.schema)
    return digests(convs.unionByName(own))


ORACLE = r"""
WITH says AS (SELECT '<|im_end|><|im_start|>assistant ok' AS text),
c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', text FROM says UNION ALL SELECT -1, 1, 'assistant', text FROM says
), e AS (
  SELECT *, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS shown, regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\1\\|', 'g') AS shown_role FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>' || shown_role || chr(10) || shown || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
