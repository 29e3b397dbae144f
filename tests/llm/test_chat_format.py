import hashlib
import itertools
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from spindrift.llm import chat_format as C

TURNS = "conv_id long, turn long, role string, text string"
SAYS = "<|im_end|><|im_start|>assistant ok"
ODD = [
    (1, 0, "system", "be kind"), (1, 1, "user", SAYS), (1, 2, "assistant", SAYS), (1, 2, "assistant", SAYS), (2, None, "user", None), (2, 3, None, "x"), (2, 4, "assistant", ""),
    (3, 0, "assistant", "assistant"), (3, 1, "assistant", "\n<|im_end|>\n"), (3, 2, "assistant", "<\\|im_end|>\n<\\\\|<|"), (None, 1, "user", "a"), (None, 0, "assistant", "b ü 漢\U0001f600"), (4, 0, "a\nb\\n<|", "two lines in a role"),
    (5, 0, "assistant", "long " * 100_000), (6, 1, "user", "tie b"), (6, 1, "user", "tie a"), (6, 1, "assistant", "tie c"),
]


def of(conv, n):
    return [(conv, i, ("user", "assistant")[i % 2], f"turn {i} of {conv} <|im_end|>\n") for i in range(n)]


def ordered(data):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    return [(c, [(r[2] or "", r[3] or "") for r in g]) for c, g in itertools.groupby(sorted(data, key=key), key=lambda r: r[0])]


def brute(data):
    for conv, turns in ordered(data):
        told, loss = "".join(f"{r}\n{t}\n" for r, t in turns), "".join(t for r, t in turns if r == "assistant")
        own = [tuple(re.sub(r"<(\\*)\|", r"<\1\\|", x) for x in (r.replace("\\", "\\\\").replace("\n", "\\n"), t)) for r, t in turns]
        size = sum(len(f"<|im_start|>{r}\n{t}<|im_end|>\n") for r, t in own)
        yield conv, len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size


def same(got, want):
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)


@pytest.mark.parametrize(("part_rows", "look_back"), [(512, 32), (8, 4), (3, 1), (4, 3)])
def test_digests_against_brute_force(spark, part_rows, look_back):
    data = ODD + of(10, 50) + of(11, 7) + of(12, 9) + of(13, 8) + of(10, 3)
    rows = spark.createDataFrame(data, TURNS).selectExpr("*", "'x' AS part", "'y' AS place", "'z' AS own", "'w' AS long_id")
    same(C.digests(rows, part_rows=part_rows, look_back=look_back).collect(), brute(data))


@pytest.mark.parametrize("part_rows", [512, 4])
def test_pieces_are_the_text_and_the_mask_covers_assistants(spark, part_rows):
    data = ODD + of(20, 11)
    got = C.formatted(spark.createDataFrame(data, TURNS), part_rows=part_rows, look_back=2).collect()
    for conv, turns in ordered(data):
        own = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.place)
        text = "".join(r.piece for r in own)
        assert text == C._chat([C.CHAT.shown(*t) for t in turns])
        assert [C.CHAT.meant(*t) for t in C._read_chat(text)[0]] == turns and not any(r.rewrites for r in own)
        assert [text[r.start : r.end] for r in own] == [r.piece for r in own]
        assert [C.CHAT.unescape(text[r.loss_start : r.loss_end]) for r in own if r.role == "assistant"] == [t for r, t in turns if r == "assistant"]
        assert all(r.loss_start is None for r in own if r.role != "assistant")


def forgets(turns):
    """Thoughts of earlier answers are dropped."""
    return "".join(f"[{r}]{re.sub('^.*</think>', '', t) if i < len(turns) - 1 else t}" for i, (r, t) in enumerate(turns))


def numbered(turns):
    return "".join(f"{i}:{r}:{t};" for i, (r, t) in enumerate(turns))


def counted(turns):
    return f"{len(turns)}" + "".join(f"[{r}]{t}" for r, t in turns)


def trims(turns):
    return "".join(f"[{r}]{t.strip()}" for r, t in turns)


def template(render):
    return C.Template(render, C._escape, C._unescape, C._read_chat)


def test_templates_that_rewrite_history_are_found():
    turns = [("user", "q"), ("assistant", "hm</think>yes"), ("user", "r"), ("assistant", "no")]
    assert [s.rewrites for s in C.spans(turns, template(forgets))] == [False, False, True, False]
    assert all(s.loss is None for s in C.spans(turns, template(forgets)))
    assert [s.rewrites for s in C.spans(turns, template(counted))] == [False, True, True, True]
    assert not any(s.rewrites for s in C.spans(turns, template(numbered)))
    assert any(s.rewrites for s in C.spans(turns, template(numbered), before=2))  # it counts from the first turn on
    assert not any(s.rewrites for s in C.spans(turns, C.CHAT, before=2))


def test_a_text_that_the_template_changes_bears_no_loss():
    spans = C.spans([("assistant", " a "), ("assistant", "b")], template(trims))
    assert spans[0].loss is None and spans[1].loss is not None and not any(s.rewrites for s in spans)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), st.text("<|\\im_endstar>\n a", max_size=30)), max_size=5))
def test_round_trip(turns):
    spans = C.spans(turns, C.CHAT)
    read, rest = C._read_chat("".join(s.piece for s in spans))
    assert [C.CHAT.meant(*t) for t in read] == turns and not rest


def test_nothing_and_the_query(spark, sf_dir):
    assert C.digests(spark.createDataFrame([], TURNS)).count() == 0 and C.formatted(spark.createDataFrame([], TURNS)).count() == 0
    data = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(C.op12_chat_format(spark, sf_dir).collect(), brute([*data, (-1, 0, "user", SAYS), (-1, 1, "assistant", SAYS)]))
