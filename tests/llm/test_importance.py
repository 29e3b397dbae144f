import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from spindrift.llm import _crc
from spindrift.llm import importance as I

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TARGET = ["the licence of the text", "une phrase du but du texte " * 3, None, "", "A B c"]


def features(text, most, buckets):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]


def brute(data, target, most, buckets, percent, least):
    s, t = [0] * buckets, [0] * buckets
    for texts, held in ((data, s), (target, t)):
        for text in texts:
            for b in features(text if isinstance(text, str | None) else text[1], most, buckets)[1]:
                held[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for d, text, *_ in data:
        n, own = features(text, most, buckets)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    wanted = percent * len(able) // 100
    return [(*r, None) for r in out if r[1] < least] + [(*r, i if i <= wanted else None) for i, r in enumerate(able, 1)]


@pytest.mark.parametrize(("most", "buckets", "percent", "least"), [(1, 10_000, 10, 20), (3, 97, 50, 1), (2, 10_000, 100, 0)])
def test_against_brute_force(spark, frame, rows, odd_rows, most, buckets, percent, least):
    data = rows[40:200] + odd_rows + odd_rows[:3]
    got = I.resample(frame(data, clashing=True), spark.createDataFrame([(t,) for t in TARGET], "text string"), most, buckets, percent, least)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(data, TARGET, most, buckets, percent, least), key=str)


def test_one_text_with_one_id_may_fill_the_table(spark, frame):
    data = [(None, "one text that all rows share", None, None, 0)] * 300 + [(i, "another text", None, None, 0) for i in range(300)]
    got = I.resample(frame(data).repartition(5), spark.createDataFrame([("text",)], "text string"), percent=50, least_words=1)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(data, ["text"], 1, 10_000, 50, 1), key=str)


def test_empty_tables(spark, frame, rows):
    nothing = spark.createDataFrame([], "text string")
    assert I.resample(frame([]), nothing).count() == 0
    got = I.resample(frame(rows[:30]), nothing)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows[:30], [], 1, 10_000, 10, 20), key=str)


def test_crc_of_runs_follows_from_the_words():
    words = [b"a", b"some", "äöü".encode(), b"x" * 63, b"y" * 64, b"z" * 65, b"w" * 70_000, b"", b"end"]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    got = _crc.runs(_crc.of_words(data, starts, ends), ends - starts, 4)
    for k, runs in enumerate(got, 1):
        assert runs.tolist() == [zlib.crc32(b" ".join(words[i : i + k])) for i in range(len(words) - k + 1)]
    assert len(_crc.runs(np.zeros(0, np.uint32), np.zeros(0, np.int64), 3)[2]) == 0
