import hashlib
import re

import pytest

from spindrift.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(data, items):
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for a in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[a : a + n]), set()).add(i)
    for d, t, *_ in data:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for a in range(len(w) - n + 1):
                if (own := wins.get(tuple(w[a : a + n]))) is not None:
                    hit |= set(range(a, a + n))
                    found |= own - {None}
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        yield (d, len(w), len(hit), len(found), digest, bool(hit))


@pytest.mark.parametrize("most_broadcast", [2_000_000, 0])
def test_against_brute_force(spark, sf_dir, frame, rows, odd_rows, most_broadcast):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    items += [(100, "the of"), (101, "and the, re"), (None, "to"), (102, ""), (103, None), (104, "..."), items[0]]
    data = rows[40:] + odd_rows + [(8000 + i, f"x {t} y", "en", "a", 0) for i, t in items[:5]]
    out = D.contamination(frame(data, clashing=True), spark.createDataFrame(items, "item_id long, text string"), most_broadcast=most_broadcast)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(brute(data, items), key=str)


def test_filter_and_empty(spark, sf_dir, frame, rows):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    clean = {r[0] for r in brute(rows, [tuple(r) for r in bench.select("item_id", "text").collect()]) if not r[5]}
    assert {r["doc_id"] for r in D.decontaminate(frame(rows), bench).collect()} == clean
    assert D.contamination(frame([]), bench).count() == 0
    assert D.contamination(frame(rows), bench.limit(0)).filter("contaminated").count() == 0


def test_filter_with_clashing_names(spark, sf_dir, frame, odd_rows):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    df = frame(odd_rows, clashing=True)
    out = D.decontaminate(df, bench)
    hit = {r[0] for r in brute(odd_rows, [tuple(r) for r in bench.select("item_id", "text").collect()]) if r[5]}
    assert out.columns == df.columns and out.count() == sum(r[0] not in hit for r in odd_rows)


def test_fingerprints_decide(spark, sf_dir, frame, rows, monkeypatch):
    """Without winnowed fingerprints, or without their extension, no span is found."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    data = rows + [(8000 + i, f"x {t} y", "en", "a", 0) for i, t in bench.limit(5).collect()]
    assert D.contamination(frame(data), bench).filter("contaminated").count() >= 5
    made = D.shared_spans(frame(data), bench)[1]
    assert made.filter("len >= 10").count() == made.count() > 0
    monkeypatch.setattr(D, "_extent", lambda own, its: D.F.lit(0))
    assert D.contamination(frame(data), bench).filter("contaminated").count() == 0


def test_winnowing_covers_every_window():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 6, n)) for n in (0, 3, 9, 10, 11, 60, 200)]
    data, offsets = D.W.text_bytes(pa.array(texts))
    found = D.W.words(data, offsets, D.W.NON_ALNUM)
    place, _ = D.winnow(found)
    for a, b in zip(found.bounds[:-1], found.bounds[1:], strict=True):
        own = place[(place >= a) & (place < b)]
        assert not len(own) if b - a < 10 else all(((own >= i) & (own <= i + 5)).any() for i in range(a, b - 9))


def test_a_window_that_many_items_share(spark, frame, rows):
    passage = " ".join(rows[9][1].split()[:14])
    items = [(i, f"{passage} end{i}") for i in range(30)] + [(100, "one two three")]
    data = [(i, f"begin{i} {passage} go", "en", "a", 0) for i in range(20)] + [(50, "zero one two three four", None, None, 0)]
    out = D.contamination(frame(data), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(brute(data, items), key=str)


def test_a_stock_phrase_does_not_meet_itself(spark, frame):
    """Texts and items that share five words in otherwise different surroundings: no hit, and no row for a pair of them."""
    from pyspark.sql import functions as F

    phrase = "all of this was written down"
    words = lambda kind, i, n: " ".join(f"{kind}{i}x{j}" for j in range(n))
    docs = frame([(i, f"{words('a', i, 12)} {phrase} {words('b', i, 12)}", "en", "s", 0) for i in range(300)])
    items = spark.createDataFrame([(i, f"{words('c', i, 12)} {phrase} {words('d', i, 12)}") for i in range(300)], "item_id long, text string")
    assert D.contamination(docs, items).filter("contaminated").count() == 0
    made = D.fingerprinted(items, "item_id", None, {}).select(F.explode("prints").alias("p")).select("p.*").withColumn("items", F.array())
    prints = D.fingerprinted(docs, "doc_id", None, {}).select("text_key", F.explode("prints").alias("p")).select("text_key", "p.*")
    beside = D._beside()
    met = prints.select("print", F.explode(beside).alias("k")).join(made.select("print", F.explode(beside).alias("k")), ["print", "k"])
    # fingerprints within the phrase whose neighbours on one side are the phrase's own words; all others part
    assert met.count() < 300 * 300 * 0.02 + 1
